"""Toxicity by a weighted finite-state grammar of clauses.

Words and marks map to classes (insult, threat, target, negation, reporting verb, kinds of marks). Two phrase transducers read
insults and threats of several words ("waste of space", "I will kill"): tries over words that put out the class and
weight of the longest phrase. Three more read the classes: one remembers a negation for a few words; one follows reported speech,
from a reporting verb to the clause's end, over a colon, a comma right behind the verb or an
opening quotation mark to the end of the sentence or quotation, and from a closing mark back where a reporting
verb follows it ("...", she said); one whether somebody is addressed. Their composition is one table; for every insult
or threat it puts out the clause pattern (asserted, negated or reported), and at the clause's end whether it was aimed
at a target. A document's evidence is, per pattern, the summed weight of its matches; a logistic model
turns that into a score. So a word counts by the clause that it stands in.

The insult lexicon and all weights are learned from labelled rows: stems (beginnings of words) that stand in
many toxic and few other texts are taken greedily until each toxic text is explained, in addition to a fixed
list of general insults, threats, targets, negations and reporting verbs. The fit uses at most ``max_rows`` labelled rows
(those with the smallest hashes of their ids) and of their stems the ``candidates`` that stand in most toxic texts, two documented
bounds; scoring covers every whole text.

Defined results: a null or empty text has no clause and gets the model's base score; without labelled
rows of both classes the default weights are used; null ids are never training rows; of several labels of
a document the largest counts; repeated rows get equal scores; a quotation that its line does not close is none; an empty table gives an
empty result. Extra columns are ignored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

INSULTS = ("idiot idiots moron morons imbecile cretin scum scumbag trash loser losers stupid dumb worthless pathetic "
           "disgusting clown jerk bastard filth vermin subhuman parasite retard freak bitch asshole dumbass").split()
THREATS = "kill murder hurt strangle stab shoot lynch exterminate behead".split()
TARGETS = "you your you're yourself they them their he him she her these those people du dich ihr euch tu toi vous usted ustedes".split()
NEGATIONS = "not no never isn't aren't wasn't don't won't nobody nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says called calls wrote claimed reported quoted alleged told sagte schrieb dit dijo".split()

#: Phrases by rule: each word of the first list, then "of", then each of the second; each beginning with a verb of harm.
HEADS, FILTH = "piece waste sack bunch load".split(), "trash garbage filth crap shit space air nothing idiots morons losers".split()
RESOLVES = ("i will,i'll,i'm going to,i am going to,i'm gonna,i want to,we will,we'll,we're going to,we are going to,ich werde,je vais,voy a,"
            "you should,you will,you'll,someone should").split(",")
WARNINGS = ("watch your back", "know where you live", "you are dead", "you're dead", "hope you die", "drop dead", "kill yourself")
PHRASE_WEIGHT = 2.0
REPORT_WORDS = frozenset(REPORTS)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA, COLON, STOP, OPEN, OPEN_REPORTED, CLOSE = range(12)
MARKS = range(COMMA, CLOSE + 1)
REACH = 3  # words that a negation reaches
NEAR = 2  # words after a reporting verb over which it reaches a comma
AFTER = 4  # words after a quotation among which a verb reports it
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "”": "”"}
TOKEN = re.compile(r"[^\W_]+(?:'[^\W\d_]+)*")
READ = re.compile(rf"({TOKEN.pattern})|([.;!?()\[\]{{}}]+)|(,)|(:)|([\"“”„«»])")
FOLLOWING = re.compile(rf"[\s,]*({TOKEN.pattern})")
LINE = re.compile(r"[\n\r]")
PATTERNS = [(kind, mood, aimed) for kind in ("insult", "threat") for mood in ("asserted", "negated", "reported") for aimed in (0, 1)]
DEFAULT = {("insult", "asserted"): 4.0, ("insult", "negated"): 0.5, ("insult", "reported"): 1.0,
           ("threat", "asserted"): 1.0, ("threat", "negated"): 0.0, ("threat", "reported"): 0.2}

# States of reported speech: none, a verb earlier in the sentence, carried to the sentence's end, in a reported quotation, in
# another quotation (without, with a verb in its clause), then a verb 0, 1, ... NEAR and more words ago.
PLAIN, EARLIER, CARRIED, QUOTED, QUOTING, QUOTING_REPORT, VERB = range(7)
REPORT_STATES = VERB + NEAR + 2
REPORTING = frozenset((CARRIED, QUOTED, QUOTING_REPORT, *range(VERB, REPORT_STATES)))


def negation(state: int, cls: int) -> int:
    return 0 if cls in MARKS else REACH if cls == NEGATION else max(0, state - 1)


def reported(state: int, cls: int) -> int:
    if state == QUOTED:
        return PLAIN if cls == CLOSE else QUOTED
    if state in (QUOTING, QUOTING_REPORT):
        return PLAIN if cls == CLOSE else QUOTING_REPORT if cls == REPORT else QUOTING if cls in MARKS else state
    if cls == REPORT:
        return CARRIED if state == CARRIED else VERB
    if cls == STOP:
        return PLAIN
    if cls == OPEN_REPORTED or cls == OPEN and state != PLAIN:
        return QUOTED
    if cls == OPEN:
        return QUOTING
    if state >= VERB:
        if cls == COLON:
            return CARRIED
        if cls == COMMA:
            return CARRIED if state <= VERB + NEAR else EARLIER
        return min(state + 1, REPORT_STATES - 1)
    return state


def target(state: int, cls: int) -> int:
    return 0 if cls in MARKS else 1 if cls == TARGET else state


def compose() -> list[list[tuple[int, int | None]]]:
    """The product of the three machines: table[state][class] = (next state, mood put out). A state is
    (negation, reported, target) as a number; its lowest bit is the target's."""
    table = []
    for state in range((REACH + 1) * REPORT_STATES * 2):
        n, r, t = state // 2 // REPORT_STATES, state // 2 % REPORT_STATES, state & 1
        row = []
        for cls in range(CLOSE + 1):
            to = (negation(n, cls) * REPORT_STATES + reported(r, cls)) * 2 + target(t, cls)
            mood = (2 if r in REPORTING else 1 if n else 0) if cls in (INSULT, THREAT) else None
            row.append((to, mood))
        table.append(row)
    return table


TABLE = compose()


def phrases() -> dict[str, dict]:
    """The phrase transducers as one trie over words; key None holds what a phrase puts out."""
    trie: dict = {}
    found = [(f"{head} of {end}", INSULT) for head in HEADS for end in FILTH]
    found += [(f"{start} {verb}", THREAT) for start in RESOLVES for verb in THREATS] + [(w, THREAT) for w in WARNINGS]
    for phrase, cls in found:
        at = trie
        for word in phrase.split():
            at = at.setdefault(word, {})
        at[None] = (cls, PHRASE_WEIGHT)
    return trie


PHRASES = phrases()
#: Phrases without a word of the lexicon at their end have to be looked for by themselves.
TRIGGERS = [f"of {end}" for end in FILTH] + list(WARNINGS)


@dataclass
class Model:
    """lexicon: class and weight of each insult or threat; stems: weight of learned insult stems; weights:
    of each of PATTERNS."""

    lexicon: dict[str, tuple[int, float]]
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [DEFAULT[p[:2]] + 0.5 * p[2] for p in PATTERNS])
    bias: float = -2.5

    def __post_init__(self):
        self.classes = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a word."""
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        return self.lexicon.get(word) or (self.classes.get(word, OTHER), 0.0)

    def matcher(self):
        found = ahocorasick.Automaton()
        for w in TRIGGERS:
            found.add_word(w, (len(w), False))
        for w in [*self.lexicon, *self.stems]:
            found.add_word(w, (len(w), w in self.stems))
        found.make_automaton()
        return found

    def classes_of(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """Classes and weights of a clause's words, the longest phrase at a time. A phrase's targets count as well."""
        i = 0
        while i < len(words):
            at, end, put = PHRASES, i, None
            while end < len(words) and (at := at.get(words[end])) is not None:
                end += 1
                if None in at:
                    put, upto = at[None], end
            if put is None:
                yield self.read(words[i])
                i += 1
            else:
                for word in words[i:upto]:
                    if self.classes.get(word) == TARGET:
                        yield TARGET, 0.0
                yield put
                i = upto


def _quotation(text: str, start: int, mark: str, end: int) -> tuple[int, int]:
    """Where the quotation opened at ``start`` closes (-1: not in its line), and its class by what follows it."""
    at = text.find(QUOTES[mark], start + 1, end)
    if at < 0:
        return -1, COMMA
    pos = at + 1
    for _ in range(AFTER):
        m = FOLLOWING.match(text, pos, end)
        if m is None:
            break
        if m[1] in REPORT_WORDS:
            return at, OPEN_REPORTED
        pos = m.end()
    return at, OPEN


def line_evidence(text: str, start: int, end: int, model: Model, out: list[float]) -> None:
    """Adds the evidence of a line's clauses."""
    state, closing, words = 0, -1, []

    def clause(state: int) -> int:
        puts = []
        for cls, weight in model.classes_of(words):
            state, mood = TABLE[state][cls]
            if mood is not None:
                puts.append((cls, mood, weight))
        for cls, mood, weight in puts:
            out[(cls - INSULT) * 6 + mood * 2 + (state & 1)] += weight
        words.clear()
        return state

    for m in READ.finditer(text, start, end):
        if m[1]:
            words.append(m[1])
            continue
        state = clause(state)
        if m[5] is None:
            cls = STOP if m[2] else COMMA if m[3] else COLON
        elif m.start() == closing:
            cls, closing = CLOSE, -1
        elif closing >= 0 or m[5] not in QUOTES:
            cls = COMMA
        else:
            closing, cls = _quotation(text, m.start(), m[5], end)
        state = TABLE[state][cls][0]
    clause(state)


def evidence(text: str, model: Model, matcher) -> list[float]:
    """Summed weight per pattern. The matcher skips the lines without any lexicon word."""
    out, text, done = [0.0] * len(PATTERNS), text.lower(), -1
    for last, (n, stem) in matcher.iter(text):
        start = last - n + 1
        if start < done or (start and text[start - 1].isalnum()) or (not stem and last + 1 < len(text) and text[last + 1].isalnum()):
            continue
        begin = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1
        done = m.start() if (m := LINE.search(text, last + 1)) else len(text)
        line_evidence(text, begin, done, model, out)
    return [math.log1p(x) for x in out]


def probability(x: list[float], model: Model) -> float:
    z = model.bias + sum(w * v for w, v in zip(model.weights, x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``max_rows`` (text, y) of the labelled documents outside the held-out fold, one per text."""
    rows = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
            .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
            .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = stored(rows, "toxic-sample")  # at most max_rows pairs of numbers: bounded, so sent to every task
    found = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    one = stored(found.join(F.broadcast(rows), "id").filter("text IS NOT NULL")
                 .groupBy(F.md5("text").alias("digest")).agg(F.min("id").alias("id"), F.max("y").alias("y")), "toxic-distinct")
    return found.join(F.broadcast(one), ["id"]).select("id", "text", "y")


def held_out(id_col: str):
    """The fold that labels are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _learn_stems(sample: DataFrame, support: int, candidates: int) -> list[tuple[str, float]]:
    """Beginnings of words (4 letters or more) that mark toxic texts, with their log odds. Inflected forms of
    one insult share a stem and are rarely frequent one by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, n = {}, {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([bad.get(x, 0) for x in n], pa.int64()),
                                              pa.array(list(n.values()), pa.int64())], names=["stem", "bad", "n"])
            bad.clear(), n.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for stem in stems_of(text):
                    n[stem] = n.get(stem, 0) + 1
                    if y:
                        bad[stem] = bad.get(stem, 0) + 1
                if len(n) > 400_000:
                    yield flush()
        yield flush()

    per = (sample.select("id", "text", "y").mapInArrow(count, "stem string, bad bigint, n bigint").groupBy("stem")
           .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
           .filter((F.col("bad") >= support) & (F.col("bad") >= 0.6 * F.col("n")))
           .orderBy(F.desc("bad"), F.desc(F.length("stem")), "stem").limit(candidates))
    top = {r["stem"]: (r["bad"], r["n"] - r["bad"]) for r in per.collect()}  # at most ``candidates`` stems
    # of nested stems in the same texts the longest says most
    nested = {t[:k] for t, c in top.items() for k in range(4, len(t)) if top.get(t[:k]) == c}
    top = {s: c for s, c in top.items() if s not in nested}
    if not top:
        return []

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(s for s in stems_of(t) if s in top) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.string()))], names=["stems"])

    rows = sample.filter("y = 1").select("id", "text", "y").mapInArrow(found, "stems array<string>").collect()
    left, chosen = [set(r["stems"]) for r in rows if r["stems"]], []  # at most max_rows short lists
    while left:  # the stem that explains most of the toxic texts not yet explained, less the others it stands in
        gain: dict[str, int] = {}
        for x in left:
            for s in x:
                gain[s] = gain.get(s, -2 * top[s][1]) + 1
        stem = min(gain, key=lambda s: (-gain[s], -len(s), s))
        if gain[stem] < support:
            break
        bad, other = top[stem]
        chosen.append((stem, math.log((bad + 1) / (other + 1))))
        left = [x for x in left if stem not in x]
    return chosen


def stems_of(text: str) -> set[str]:
    return {w[:k] for w in set(TOKEN.findall(text.lower())) for k in range(4, min(len(w), 12) + 1)}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[list[float], float]:
    """Logistic regression by Newton's method; patterns never seen keep weight 0."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, support: int = 3, candidates: int = 2_000,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn lexicon and pattern weights from the labelled rows outside the held-out fold."""
    lexicon = {w: (INSULT, 1.0) for w in INSULTS} | {w: (THREAT, 1.0) for w in THREATS}
    sample = stored(training_rows(docs, labels, max_rows, id_col, text_col, label_col), "toxic-texts")
    model = Model(lexicon, {w: x for w, x in _learn_stems(sample, support, candidates)})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            x = [evidence(t, model, matcher) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.select("id", "text", "y").mapInArrow(features, "y int, x array<double>").collect()  # at most max_rows short rows
    rows.sort(key=lambda r: (r["y"], r["x"]))  # sums in one order: reruns agree
    y = np.array([r["y"] for r in rows], float)
    if len(rows) and 0 < y.sum() < len(y):
        weights, bias = _fit(np.array([r["x"] for r in rows]), y)
        seen = np.array([r["x"] for r in rows]).any(axis=0)
        # patterns that no labelled row shows keep their default
        model.weights = [w if s else d for w, s, d in zip(weights, seen, model.weights)]
        model.bias = min(bias, -0.5)  # no evidence is never toxic
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, evidence (per pattern, see PATTERNS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [evidence(t or "", model, matcher) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([probability(v, model) for v in x], pa.float64()), pa.array(x, pa.list_(pa.float64()))],
                    names=["doc_id", "score", "evidence"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id bigint, score double, evidence array<double>"))


def clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keep = [probability(evidence(t or "", model, matcher), model) < limit for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
