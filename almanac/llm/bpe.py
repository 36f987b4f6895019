"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

:class:`Encoder` reads a text in pieces and hands out token ids as soon as no later input can change
them. What it holds back is bounded by the rule that needs it: a possible start of a special token, the
last character that a combining mark could still join, the last pre-token. Pre-tokens of ordinary length
are merged when their end is known (and remembered in a bounded cache). A pre-token longer than ``LONG``
symbols is streamed: the last token of every prefix is the one token that ends there and is compatible
with the last token of the prefix before it (two tokens are compatible if encoding their joined string
gives back the two). A later token starts at one of the last ``lookahead`` positions, the longest token
of the merge list; tokens that all those prefixes share are stable and go out.

:class:`Decoder` is the reverse state machine: ids in, text out, keeping at most the bytes of an
unfinished UTF-8 character.

Defined results: a null text is the empty text (no tokens, empty output); a null id stays null; repeated
rows give repeated results; texts of any length use the same memory beyond the text and its ids."""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 512
BLOCK = 1 << 16
CACHE = 1 << 18
ROWS = 128
NONE = 1 << 60
#: Unicode white space, as the splitting pattern of the tokenizer file means it.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file (kind ``word``: lower case, byte-level symbols, word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.pair.setdefault((self.ids[a], self.ids[b]), rank)
            self.made.append(self.ids[a + b])
        chars = byte_chars()
        self.start = [self.ids[c] for c in chars]  # the symbol of each byte, and of each byte that ends a pre-token
        self.end = [self.ids[c + self.suffix] for c in chars]
        self.to_chars = dict(enumerate(chars))
        self.to_byte = {c: b for b, c in enumerate(chars)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", SPACE))
        self.letters, self.others = regex.compile(r"\p{L}+"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")
        self.space = regex.compile(f"[{SPACE}]")
        #: No token covers more symbols: a token that ends later starts within so many of the last positions.
        self.lookahead = max(len(s.removesuffix(self.suffix) if self.suffix else s) for s in self.ids)
        self._fits: dict[tuple[int, int], bool] = {}

    def symbols(self, chars: str, ends: bool) -> list[int]:
        out = [self.ids[c] for c in chars]
        if ends and self.suffix:
            out[-1] = self.ids[chars[-1] + self.suffix]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges, the lowest rank first and the leftmost of equal rank."""
        get, made = self.pair.get, self.made
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), NONE)
        return ids

    def chars(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() and " " not in text else "".join(map(self.to_chars.__getitem__, text.encode()))

    def word(self, text: str) -> list[int]:
        data = text.encode()
        ids = [self.start[b] for b in data]
        ids[-1] = self.end[data[-1]]
        return self.merge(ids)

    def fits(self, a: int | None, b: int) -> bool:
        """Whether ``b`` may follow ``a``: the pair, encoded as one string, stays these two tokens."""
        key = (-1 if a is None else a, b)
        if (known := self._fits.get(key)) is None:
            s, left = self.pieces[b], "" if a is None else self.pieces[a]
            ends = bool(self.suffix) and s.endswith(self.suffix)
            known = self.merge(self.symbols(left + (s.removesuffix(self.suffix) if ends else s), ends)) == ([b] if a is None else [a, b])
            if len(self._fits) >= CACHE:
                self._fits.clear()
            self._fits[key] = known
        return known


class LongRun:
    """Tokens of one long pre-token, symbol by symbol."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.held = vocab, ""  # symbols read that are not taken yet: the last may turn out to end the run
        self.text, self.last = "", []  # symbols after the stable tokens; last[i]: (token, start) of the prefix ending there
        self.before: int | None = None  # the last stable token

    def _take(self, c: str, ends: bool) -> None:
        v, i = self.v, len(self.text)
        self.text += c
        for start in range(max(0, i + 1 - v.lookahead), i + 1):
            s = self.text[start:]
            t = v.ids.get(s + v.suffix if ends else s)
            if t is None or not v.fits(None, t):
                continue
            prev = self.last[start - 1][0] if start else self.before
            if prev is None or v.fits(prev, t):
                self.last.append((t, start))
                return
        raise ValueError("the merge list leaves a prefix without tokens")

    def _stable(self) -> list[int]:
        """The tokens that all of the last positions agree on, removed from what is kept."""
        n = len(self.last)
        at = set(range(max(0, n - self.v.lookahead), n))
        while len(at) > 1 and (top := max(at)) >= 0:
            at.discard(top)
            at.add(self.last[top][1] - 1)
        common = at.pop() if len(at) == 1 else -1
        return self._drop(common)

    def _drop(self, upto: int) -> list[int]:
        out, i = [], upto
        while i >= 0:
            t, start = self.last[i]
            out.append(t)
            i = start - 1
        if out:
            self.before = out[0]
            self.text = self.text[upto + 1:]
            self.last = [(t, s - upto - 1) for t, s in self.last[upto + 1:]]
        return out[::-1]

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        chars, self.held = self.held + chars[:-1], chars[-1:] or self.held
        for k, c in enumerate(chars):
            self._take(c, False)
            if k % 256 == 255:
                out += self._stable()
        return out + self._stable()

    def finish(self) -> list[int]:
        self._take(self.held, True)
        return self._drop(len(self.last) - 1)


class Encoder:
    """One text: ``feed`` its pieces in order, then ``finish``; both return token ids as bytes
    (little-endian unsigned 32-bit integers)."""

    def __init__(self, vocab: Vocabulary, cache: dict[str, bytes] | None = None):
        self.v, self.cache = vocab, cache if cache is not None else WordCache(vocab)
        self.special = regex.compile("|".join(map(regex.escape, vocab.special)) or r"(?!)")
        self._reset()
        self.raw = ""  # may be the start of a special token

    def _reset(self) -> None:
        self.joining = ""  # a later combining mark may still change it
        self.tail = ""  # unfinished pre-tokens
        self.run: LongRun | None = None
        self.goes_on = None  # pattern of the run's class

    def feed(self, text: str, last: bool = False) -> bytes:
        out, text = [], self.raw + text
        self.raw = ""
        if "<" in text:
            at = 0
            for m in self.special.finditer(text):
                out.append(self._segment(text[at:m.start()], True))
                out.append(_pack([self.v.special[m.group()]]))
                at = m.end()
            text = text[at:]
            if not last:
                keep = max((k for s in self.v.special for k in range(1, len(s)) if text.endswith(s[:k])), default=0)
                text, self.raw = text[:len(text) - keep], text[len(text) - keep:]
        out.append(self._segment(text, last))
        return b"".join(out)

    def finish(self) -> bytes:
        return self.feed("", True)

    def _segment(self, text: str, last: bool) -> bytes:
        text, self.joining = self.joining + text, ""
        if not last and text:
            cut = len(text) - 1
            while cut and _may_join(text[cut]):
                cut -= 1
            text, self.joining = text[:cut], text[cut:]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # one character at a time: no final sigma
        out = self._scan(text.lower(), last)
        if last:
            self._reset()
        return out

    def _scan(self, text: str, last: bool) -> bytes:
        v, out = self.v, []
        if self.run:
            m = self.goes_on.match(text)
            n = m.end() if m else 0
            if n:
                out += self.run.feed(v.chars(text[:n]))
            if n == len(text) and not last:
                return _pack(out)
            out += self.run.finish()
            self.run, text = None, text[n:]
        text, self.tail = self.tail + text, ""
        if not last:
            cut = max((m.end() for m in self.v.space.finditer(text, max(0, len(text) - LONG))), default=None)
            if cut is None:
                cut = self._open(text)
            elif len(text) - cut < LONG:
                self.tail = text[cut:]
            text = text[:cut]
        # pre-tokens hold no white space, so chunks between it are remembered whole; split() also splits
        # at four control characters that are no white space here
        chunks = v.pattern.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        words = b"".join(map(self.cache.__getitem__, chunks))
        if self.run:  # an earlier run's last tokens, the words, the new run
            return _pack(out) + words + _pack(self.run.feed(self._opening))
        return _pack(out) + words if out else words

    def _open(self, text: str) -> int:
        """No white space near the end: where the pre-tokens that can still change begin."""
        matches = [m.span() for m in self.v.pattern.finditer(text)][-2:]
        if not matches:
            return len(text)
        start, end = matches[-1]
        if end - start < LONG:
            self.tail = text[matches[0][0]:]  # a contraction may still form across the last two
            return matches[0][0]
        self.goes_on = self.v.letters if self.v.letters.match(text, start) else self.v.others
        self.run, self._opening = LongRun(self.v), self.v.chars(text[start:])
        return start

    def encode(self, text: str) -> bytes:
        if len(text) <= BLOCK:
            return self.feed(text, True)
        return b"".join([*(self.feed(text[i:i + BLOCK]) for i in range(0, len(text), BLOCK)), self.finish()])


class WordCache(dict):
    """Packed ids by chunk of text between white space, and by pre-token; the older half of what was
    used goes when full."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.old = vocab, {}

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            words = self.v.pattern.findall(chunk)
            if words != [chunk]:
                ids = b"".join(map(self.__getitem__, words))
            elif len(chunk) > LONG:
                run = LongRun(self.v)
                return _pack(run.feed(self.v.chars(chunk)) + run.finish())
            else:
                ids = _pack(self.v.word(chunk))
            if len(chunk) > LONG:
                return ids
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class Decoder:
    """Ids to text. A tokenizer file without a decoder joins its pieces by one space (``joined``);
    otherwise symbols become bytes, word ends become spaces, and an unfinished character waits."""

    def __init__(self, vocab: Vocabulary, joined: bool = True):
        self.v, self.joined, self.begun = vocab, joined, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        pieces = map(self.v.pieces.__getitem__, ids)
        if self.joined:
            text = " ".join(pieces)
            text, self.begun = (" " + text if self.begun and len(ids) else text), self.begun or len(ids) > 0
            return text
        out, suffix = bytearray(), self.v.suffix
        for p in pieces:
            ends = suffix and p.endswith(suffix)
            out += bytes(map(self.v.to_byte.__getitem__, p.removesuffix(suffix) if ends else p))
            out += b" " if ends else b""
        return self.utf8.decode(bytes(out))

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


def _may_join(c: str) -> bool:
    """Whether ``c`` may combine with what stands before it, so the text can't be cut ahead of it."""
    return not c.isascii() and (unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ")


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def transcode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (the text that the
    ids decode to). One pass without a shuffle; ``path`` is the tokenizer file on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(path)
        cache = WordCache(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, texts = [], []
                for text in part.column(1).to_pylist():
                    ids.append(Encoder(vocab, cache).encode(text or ""))
                    decoder = Decoder(vocab)
                    texts.append(decoder.feed(memoryview(ids[-1]).cast("I")) + decoder.finish())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string"))
