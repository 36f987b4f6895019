"""Personal data: detection and surrogates.

Every detected entity is replaced by a made-up one of its kind and format: letters by letters of the same
script and case, digits by digits, a card number keeps its valid check digit, an address stays a valid
address, a name keeps gender and script. Surrogates come from a keyed hash of the normalised original, so
one person, address or number gets the same surrogate in all documents (coreference), whatever its spelling,
and the parts of names and e-mail addresses are replaced part by part.

Distinct originals must keep distinct surrogates, and no surrogate may be another original of the corpus.
That is checked over all distinct originals: where it fails, all but the smallest of the originals that
meet get another try, until none meet. From the fifth try on a surrogate grows by a character (a name by a
syllable) a try, so short formats and crowded kinds settle too; keys, hex tokens and IP addresses have room
for billions and keep their length. A form without letters and digits gets symbols (a secret) or letters (a
part of an address). Documents learn of the few second tries by a join.

What a document names once is looked for in the whole document again (an Aho-Corasick pass over its entities): words of a
name wherever they stand as words with a capital, user names that look like handles or hold such a word, and secrets, keys and
tokens. They get the surrogate of the entity, so no mention of it is left.

Defined results: a null text stays null without entities; texts without entities are unchanged; repeated
rows get equal results; a null id is kept (its second tries are looked up by text as well); an empty table
gives an empty result. Extra columns are ignored."""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROWS = 256
TITLES = {"m": "Mr Herr Señor Sr Monsieur господин κύριος", "f": "Mrs Ms Miss Frau Señora Sra Madame Mme госпожа κυρία", "u": "Dr Prof"}
GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts.split()}
END_MARKS = ".,;:!?)"
HANDLE = regex.compile(r"[0-9._]")  # user names that are no plain words
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
NAME = rf"\b(?P<title>{'|'.join(sorted((t for ts in TITLES.values() for t in ts.split()), key=len, reverse=True))})\.?\s+(?P<name>\p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}})"
#: Detectors in order of precedence: the pattern, and one without which a text holds none.
DETECTORS = [(kind, regex.compile(pattern), regex.compile(needs)) for kind, pattern, needs in (
    ("email", r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", "@"),
    ("ip", rf"(?<![\d.])(?P<ip>(?:{OCTET}\.){{3}}{OCTET})(?!\.?\d)", r"\d\.\d"),
    ("key", r"\b(?P<key>AKIA[0-9A-Z]{16})\b", "AKIA"),
    ("hex", r"\b(?P<hex>[0-9a-f]{32,64})\b", "[0-9a-f]{32}"),
    ("secret", r"(?i:password|passwd|pwd|secret|api_key|token)\s*[=:]\s*[\"']?(?P<secret>[^\s\"']{6,})", "[=:]"),
    ("card", r"(?<![\d.])(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?!\d)", r"\d{4}[ -]?\d{4}"),
    ("phone", r"(?<![\w.])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4})(?!\d)", r"\d[) .-][ .-]?\d{3}"),
    ("name", NAME, rf"\b(?:{'|'.join(t for ts in TITLES.values() for t in ts.split())})\b"))]
SYLLABLES = {"latin": "ba be bo da de di fa ga ka ke la le li lo ma me mi na ne no ra re ri ro sa se so ta te to va vi".split(),
             "cyrillic": "ба бе бо да де ди ка ке ла ле ли ло ма ме ми на не но ра ре ри ро са се со та те то ва ви".split(),
             "greek": "βα βε δα δε δι κα κε λα λε λι λο μα με μι να νε νο ρα ρε ρι ρο σα σε σο τα τε το".split()}
ENDS = {"latin": {"m": "n", "f": "na", "u": "l"}, "cyrillic": {"m": "н", "f": "на", "u": "л"}, "greek": {"m": "ς", "f": "να", "u": "λ"}}
SYMBOLS = "!#$%&*+-=?@^_~"
#: Tries that keep the original's length.
SAME_LENGTH = 4
ALPHABETS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def script(text: str) -> str:
    names = [unicodedata.name(c, "") for c in text if c.isalpha()]
    return next((s for s in ("cyrillic", "greek") if any(n.startswith(s.upper()) for n in names)), "latin")


def luhn(digits: str) -> int:
    """The check digit of ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def parts(kind: str, match: str, title: str | None = None) -> list[tuple[str, str, str]]:
    """The (kind, normal form, spelling) of what is replaced on its own."""
    if kind == "email":
        user, _, domain = match.rpartition("@")
        host, _, top = domain.rpartition(".")
        return [("user", user.lower(), user), ("host", host.lower(), host)]
    if kind == "name":
        words = match.split(" ")
        gender = GENDER.get((title or "").casefold(), "u")
        return [*((f"given {gender}", w.casefold(), w) for w in words[:-1]), ("family", words[-1].casefold(), words[-1])]
    if kind in ("card", "phone"):
        return [(kind, "".join(c for c in match if c.isdigit() or c == "+"), match)]
    return [(kind, match, match)]


class Maker:
    """Surrogates under a key. ``tries`` holds the originals that need another try: (kind, normal) -> number."""

    def __init__(self, key: bytes, tries: dict[tuple[str, str], int] | None = None):
        self.key, self.tries = key, tries or {}

    def _stream(self, kind: str, normal: str, n: int) -> Iterator[int]:
        seed, block = f"{kind}\0{normal}\0{n}".encode(), 0
        while True:
            yield from hashlib.blake2b(seed + block.to_bytes(4, "little"), key=self.key).digest()
            block += 1

    def normal(self, kind: str, normal: str, n: int | None = None) -> str:
        """The surrogate's normal form, of the original's format; longer after some tries."""
        n = self.tries.get((kind, normal), 0) if n is None else n
        bits = self._stream(kind, normal, n)
        number = lambda top: (next(bits) << 16 | next(bits) << 8 | next(bits)) % top
        more = max(0, n - SAME_LENGTH + 1)
        if kind == "ip":
            return ".".join(str(1 + number(254)) for _ in range(4))
        if kind.startswith(("given", "family")):
            s = script(normal)
            word = "".join(SYLLABLES[s][number(len(SYLLABLES[s]))] for _ in range((3 if kind != "family" else 4) + more))
            return word + ENDS[s][kind[-1] if kind != "family" else "u"]
        keep = {"key": 4, "card": 1}.get(kind, 0)
        if kind == "phone" and normal.startswith("+"):
            keep = max(2, len(normal) - 10)
        out, form = list(normal[:keep]), normal[keep:]
        varied = [c for c in form if c.isdigit() or c.isalpha()]
        if not varied:
            letters = SYMBOLS if kind == "secret" else "abcdefghijklmnopqrstuvwxyz"
            return "".join(letters[number(len(letters))] for _ in range(len(form) + more))
        if kind not in ("hex", "key"):
            form += varied[-1] * more
        for c in form:
            if kind == "hex":
                out.append("0123456789abcdef"[number(16)])
            elif kind == "key":
                out.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[number(36)])
            elif c.isdigit():
                out.append(str(number(10) if len(out) > keep or kind not in ("phone", "card") else 1 + number(9)))
            elif c.isalpha():
                letters = ALPHABETS.get(script(c), "abcdefghijklmnopqrstuvwxyz")
                x = letters[number(len(letters))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        if kind == "card" and int(normal[-1]) == luhn(normal[:-1]):
            out[-1] = str(luhn("".join(out[:-1])))
        return "".join(out)

    def spelled(self, kind: str, normal: str, spelling: str) -> str:
        """The surrogate as the original was spelled: case, and for numbers the marks between digits."""
        new = self.normal(kind, normal)
        if kind in ("card", "phone"):
            digits = iter(new.removeprefix("+"))
            return "".join([next(digits) if c.isdigit() else c for c in spelling] + [*digits])
        if kind.startswith(("given", "family")):
            return new.upper() if spelling.isupper() and len(spelling) > 1 else new[:1].upper() + new[1:]
        if kind == "secret" and len(spelling) < len(normal) == len(new):
            return new[:len(spelling)]
        if kind in ("user", "host") and len(new) == len(spelling):
            return "".join(n.upper() if c.isupper() else n for n, c in zip(new, spelling))
        return new


def found(text: str) -> Iterator[tuple[int, int, str, list[tuple[str, str, str]]]]:
    """(start, end, kind, parts) of every entity that its form shows, from left to right; where several detectors match at
    one place the first of them counts."""
    ahead = [(m.start(), i, m) for i, (_, pattern, needs) in enumerate(DETECTORS) if needs.search(text) and (m := pattern.search(text))]
    heapq.heapify(ahead)
    at = 0
    while ahead:
        start, i, m = heapq.heappop(ahead)
        kind, pattern, _ = DETECTORS[i]
        if start >= at:
            yield *m.span(kind), kind, parts(kind, m[kind], m["title"] if kind == "name" else None)
            at = m.end()
        if m := pattern.search(text, max(at, start)):
            heapq.heappush(ahead, (m.start(), i, m))


def lowered(text: str) -> str:
    """Lower case, character by character, so places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def mentions(text: str, seen: list[tuple[int, int, str, list[tuple[str, str, str]]]]) -> Iterator[tuple[int, int, str, list[tuple[str, str, str]]]]:
    """Further mentions of the entities in ``seen``, outside of them."""
    wanted: dict[str, tuple[str, str, str]] = {}
    names = {part[1] for _, _, kind, its in seen if kind == "name" for part in its}
    for _, _, kind, its in seen:
        for part, normal, spelling in its:
            if kind == "name" or kind in ("secret", "key", "hex"):
                wanted.setdefault(lowered(spelling), (kind, part, normal))
            if kind == "secret" and len(bare := spelling.rstrip(END_MARKS)) >= 6:  # a sentence's end may have stood behind it
                wanted.setdefault(lowered(bare), (kind, part, normal))
            elif part == "user" and (HANDLE.search(normal) or normal in names):
                wanted.setdefault(lowered(spelling), (kind, part, normal))
    if not wanted:
        return
    words = ahocorasick.Automaton()
    for w in wanted:
        words.add_word(w, w)
    words.make_automaton()
    taken, at, done = iter([*((s, e) for s, e, *_ in seen), (len(text) + 1, len(text) + 1)]), (0, 0), 0
    hits = sorted((last - len(w) + 1, -last - 1, w) for last, w in words.iter(lowered(text)))
    for start, end, w in hits:
        end = -end
        while at[1] <= start:
            at = next(taken)
        kind, part, normal = wanted[w]
        whole = not (start and _joins(text[start - 1])) and not (end < len(text) and _joins(text[end]))
        spelling = text[start:end]
        if start < done or end > at[0] or not whole or (kind == "name" and not spelling[0].isupper()) or (kind in ("secret", "key", "hex") and spelling not in (normal, normal.rstrip(END_MARKS))):
            continue
        yield start, end, kind, [(part, normal, spelling)]
        done = end


def _joins(c: str) -> bool:
    return c.isalnum() or c == "_"


def entities(text: str) -> list[tuple[int, int, str, list[tuple[str, str, str]]]]:
    """(start, end, kind, parts) of every entity and every further mention of one, in order."""
    seen = list(found(text))
    return sorted([*seen, *mentions(text, seen)], key=lambda e: e[0]) if seen else seen


def replaced(text: str, maker: Maker) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for start, end, kind, its in entities(text):
        out.append(text[at:start])
        new = [maker.spelled(*p) for p in its]
        if kind == "email" and len(new) == 2:
            out.append(f"{new[0]}@{new[1]}.{text[start:end].rpartition('.')[2]}")
        else:
            out.append(" ".join(new))
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def _originals(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), kind, normal: once per document and task batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(i, h, p[0], p[1]): None for i, h, t in zip(*(c.to_pylist() for c in batch.columns))
                    for e in entities(t or "") for p in e[3]}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 names=["doc_id", "th", "kind", "normal"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, kind string, normal string")


def tries(originals: DataFrame, key: bytes, make: type[Maker] = Maker) -> DataFrame:
    """kind, normal, n for distinct originals: the try at which no two surrogates of a kind meet and none is
    an original. Kinds of names are compared without their gender."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = make(key)
        for batch in batches:
            kinds, normals, ns = (c.to_pylist() for c in batch.columns)
            new = [maker.normal(k, o, n) for k, o, n in zip(kinds, normals, ns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "normal", "n", "new"])

    group = lambda c: F.when(F.col(c).startswith("given"), "given").otherwise(F.col(c))
    known = originals.select("kind", "normal", F.lit(0).alias("n"))
    taken = originals.select(group("kind").alias("g"), F.col("normal").alias("new")).distinct()
    while True:
        made = stored(known.mapInArrow(run, "kind string, normal string, n int, new string").withColumn("g", group("kind")), "pii-made")
        first = made.groupBy("g", "new").agg(F.min(F.struct("normal", "kind")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        met = (made.join(first, ["g", "new"]).filter(F.struct("normal", "kind") != F.col("first")).select("kind", "normal")
               .union(made.join(taken, ["g", "new"], "left_semi").select("kind", "normal"))).distinct()
        met = stored(met.withColumn("again", F.lit(1)), "pii-met")
        if not met.limit(1).count():
            return made.select("kind", "normal", "n")
        known = stored(made.select("kind", "normal", "n").join(met, ["kind", "normal"], "left")
                       .select("kind", "normal", (F.col("n") + F.coalesce("again", F.lit(0))).alias("n")), "pii-tries")


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text (with surrogates), n_entities, kinds (of the entities, in order)."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.withColumn("th", F.xxhash64("text"))
    seen = stored(_originals(keyed), "pii-originals")
    again = stored(tries(stored(seen.select("kind", "normal").distinct(), "pii-distinct"), key).filter("n > 0"), "pii-again")
    rows = base.withColumn("again", F.lit(None).cast("array<struct<kind:string,normal:string,n:int>>"))
    if again.limit(1).count():
        of = (seen.distinct().join(again, ["kind", "normal"]).groupBy("doc_id", "th")
              .agg(F.collect_list(F.struct("kind", "normal", "n")).alias("again")).withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h"))
        rows = (keyed.join(stored(of, "pii-of"), (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
                .select("doc_id", "text", "again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Maker(key)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts, kinds = [], []
                for t, more in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    maker = Maker(key, {(x["kind"], x["normal"]): x["n"] for x in more}) if more else plain
                    new, found = replaced(t, maker) if t is not None else (None, [])
                    texts.append(new)
                    kinds.append(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_entities", "kinds"])

    return rows.mapInArrow(run, "doc_id bigint, text string, n_entities bigint, kinds array<string>")
