"""Token counts that follow edits.

A document is a balanced tree over blocks of pre-tokens; every node knows the characters, pre-tokens and
tokens below it. An edit cuts out the blocks that it touches, with the few characters of context that the
splitting pattern can look at, splits that region again, and goes on to the right only until a new
boundary meets an old one; from there on the old blocks are right as they are. Only pre-tokens of the region
are encoded; the sums on the path are updated.

:func:`build` keeps a document's blocks in two columns, so the state is a table like any other;
:func:`apply_edits` reads such a state and edits and gives the new state and counts.

Defined results: a null text is the empty text; a document without edits keeps its counts; places outside
the text are moved to its ends, null edits and null parts of edits count as nothing; an empty table gives an
empty result. Extra columns are ignored."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits text before the merges of the rank files (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 64  # pre-tokens
LOOK = 3  # characters behind a pre-token that its match can depend on: a contraction is up to three long
CACHE = 1 << 18
STATE = "doc_id bigint, text string, cuts array<int>, sums array<int>"
EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"


class Counter(dict):
    """Tokens of a pre-token, remembered; the older half goes when full."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split: Callable[[str], list[str]] = regex.compile(PATTERN).findall
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if (n := self.old.get(word)) is None:
            n = len(self.encoding.encode_ordinary(word))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n

    def count(self, words: list[str]) -> int:
        return sum(map(self.__getitem__, words))


@dataclass
class Node:
    """A leaf holds a block's text; an inner node the sums of its two sides."""

    chars: int
    words: int
    tokens: int
    height: int = 0
    text: str = ""
    left: Node | None = None
    right: Node | None = None


def leaf(text: str, words: int, tokens: int) -> Node:
    return Node(len(text), words, tokens, text=text)


def over(left: Node, right: Node) -> Node:
    return Node(left.chars + right.chars, left.words + right.words, left.tokens + right.tokens,
                1 + max(left.height, right.height), left=left, right=right)


def joined(a: Node | None, b: Node | None) -> Node | None:
    """Concatenation; heights stay within one of each other, so it takes time in their difference."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return balanced(joined(a, b.left), b.right)
    return over(a, b)


def balanced(a: Node, b: Node) -> Node:
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return over(a.left, over(a.right, b))
        return over(over(a.left, a.right.left), over(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return over(over(a, b.left), b.right)
        return over(over(a, b.left.left), over(b.left.right, b.right))
    return over(a, b)


def split(node: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """Cut before the block that holds character ``at`` (or behind the last block)."""
    if node is None or at >= node.chars:
        return node, None
    if node.left is None:
        return None, node
    if at < node.left.chars:
        a, b = split(node.left, at)
        return a, joined(b, node.right)
    a, b = split(node.right, at - node.left.chars)
    return joined(node.left, a), b


def leaves(node: Node | None) -> Iterator[Node]:
    stack = [node] if node else []
    while stack:
        n = stack.pop()
        if n.left is None:
            yield n
        else:
            stack += [n.right, n.left]


def tree(parts: list[Node]) -> Node | None:
    while len(parts) > 1:
        parts = [over(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        if len(parts) > 1 and parts[-1].height < parts[-2].height - 1:
            parts[-2:] = [joined(parts[-2], parts[-1])]
    return parts[0] if parts else None


class Document:
    """One text with its tree. ``encoded`` counts the pre-tokens that were encoded so far."""

    def __init__(self, counter: Counter, text: str = "", cuts: list[int] | None = None, sums: list[int] | None = None):
        self.counter, self.encoded = counter, 0
        if cuts is None:
            self.root = tree(self._blocks(counter.split(text)))
        else:  # a kept state: block lengths and, per block, pre-tokens and tokens
            parts, at = [], 0
            for i, n in enumerate(cuts):
                parts.append(leaf(text[at:at + n], sums[2 * i], sums[2 * i + 1]))
                at += n
            self.root = tree(parts)

    def _blocks(self, words: list[str]) -> list[Node]:
        self.encoded += len(words)
        return [leaf("".join(b := words[i:i + BLOCK]), len(b), self.counter.count(b)) for i in range(0, len(words), BLOCK)]

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def words(self) -> int:
        return self.root.words if self.root else 0

    def text(self) -> str:
        return "".join(n.text for n in leaves(self.root))

    def edit(self, start: int, length: int, replacement: str) -> None:
        size = self.root.chars if self.root else 0
        start = min(max(0, start), size)
        end = min(size, start + max(0, length))
        before, rest = split(self.root, max(0, start - LOOK)) if start < size + LOOK else (self.root, None)
        if rest is None and before is not None:  # at the very end: the last block is context
            before, rest = split(before, before.chars - 1)
        at = before.chars if before else 0
        touched, after = [], rest
        while after is not None and (not touched or sum(n.chars for n in touched) < end - at):
            touched, after = self._next(touched, after)
        old = "".join(n.text for n in touched)
        region = old[:start - at] + replacement + old[end - at:]
        while True:
            ahead = next(leaves(after)).text if after else ""
            words, n = [], 0
            for w in self.counter.split(region + ahead):
                if n >= len(region):
                    break
                words.append(w)
                n += len(w)
            # in step again: a boundary where the untouched blocks begin, and a pre-token seen to its end behind it
            if after is None or n == len(region):
                break
            touched, after = self._next([], after)
            region += touched[0].text
        self.root = joined(joined(before, tree(self._blocks(words))), after)

    @staticmethod
    def _next(touched: list[Node], after: Node) -> tuple[list[Node], Node | None]:
        first = next(leaves(after))
        a, b = split(after, first.chars) if first.chars < after.chars else (after, None)
        return [*touched, *leaves(a)], b

    def state(self) -> tuple[str, list[int], list[int]]:
        parts = list(leaves(self.root))
        return "".join(n.text for n in parts), [n.chars for n in parts], [x for n in parts for x in (n.words, n.tokens)]


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The state of every document: doc_id, text, cuts (characters of each block), sums (pre-tokens and tokens
    of each block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in _parts(batches):
            rows = [Document(counter, t or "").state() for t in part.column(1).to_pylist()]
            yield _state(part.column(0), rows)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STATE)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _state(ids, rows: list[tuple]) -> pa.RecordBatch:
    text, cuts, sums = zip(*rows)
    kind = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([ids, pa.array(text, pa.string()), pa.array(cuts, kind), pa.array(sums, kind)],
                                      names=["doc_id", "text", "cuts", "sums"])


def _edited(document: Document, edits: list[dict] | None) -> int:
    done = 0
    for e in edits or ():
        if e is not None and e["start"] is not None:
            document.edit(e["start"], e["length"] or 0, e["replacement"] or "")
            done += 1
    return done


def apply_edits(state: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The state after ``edits`` (doc_id, seq, start, length, replacement; applied in order of seq). Only the
    blocks that an edit touches are split and encoded again."""
    per = edits.groupBy("doc_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))),
        lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["length"].cast("bigint").alias("length"), e["replacement"].alias("replacement"))).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in _parts(batches):
            rows = []
            for text, cuts, sums, todo in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                document = Document(counter, text, cuts, sums)
                _edited(document, todo)
                rows.append(document.state())
            yield _state(part.column(0), rows)

    return state.join(per, "doc_id", "left").select("doc_id", "text", "cuts", "sums", "edits").mapInArrow(run, STATE)


def counts(docs: DataFrame, path: str, edits=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts without keeping a state: doc_id, n_tokens and n_words before any edit, and after those of the
    column expression ``edits`` n_edits, n_tokens_edited, n_encoded_again."""
    todo = (edits if edits is not None else F.lit(None)).cast(EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in _parts(batches):
            rows = []
            for text, edit in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                document = Document(counter, text or "")
                before = document.tokens, document.words
                document.encoded = 0
                rows.append((*before, _edited(document, edit), document.tokens, document.encoded))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                                             names=["doc_id", "n_tokens", "n_words", "n_edits", "n_tokens_edited", "n_encoded_again"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), todo.alias("edits"))
            .mapInArrow(run, "doc_id bigint, n_tokens bigint, n_words bigint, n_edits bigint, n_tokens_edited bigint, n_encoded_again bigint"))
