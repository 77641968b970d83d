"""Edit-aware token counts: a segment tree of pre-token runs per document.

A document is cut where a pre-token always ends: between a character that is not white space and a
blank or line end. Tokens of the pieces add up to those of the text. The pieces are the leaves of a
sum tree; an edit re-encodes the leaves it touches, and neighbours as far as the cut beside them no
longer holds, and updates the sums above them."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import texts

#: Vocabulary of the counts, a file of ranks on the driver; tasks get its content.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a leaf at least, unless the text ends.
LEAF = 512

Edit = tuple[int, int, str]  # place, characters taken out, text put in
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def counter(key: str, ranks: dict[bytes, int]) -> Callable[[str], int]:
    """Counts tokens of a text; the encoder is built once per worker process."""
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _ENCODINGS[key].encode_ordinary
    return lambda text: len(encode(text))


def leaves_of(text: str, least: int = LEAF) -> list[str]:
    """The text in pieces of ``least`` characters or more, cut at safe places only."""
    out, start = [], 0
    while len(text) - start > least:
        m = _CUT.search(text, start + least)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.start()
    if start < len(text) or not out:
        out.append(text[start:])
    return out


def holds(left: str, right: str) -> bool:
    """Whether a pre-token surely ends between the two texts."""
    return not right or right[0] in " \n" and bool(left) and not left[-1].isspace()


@dataclass
class SumTree:
    """Sums over leaf slots in heap order: node i has children 2i and 2i + 1; leaves start at ``size``."""
    size: int
    nodes: list[int]

    @classmethod
    def of(cls, values: list[int]) -> SumTree:
        size = 1
        while size < len(values):
            size *= 2
        nodes = [0] * size + values + [0] * (size - len(values))
        for i in range(size - 1, 0, -1):
            nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
        return cls(size, nodes)

    @property
    def total(self) -> int:
        return self.nodes[1]

    def set(self, slot: int, value: int) -> None:
        i = self.size + slot
        change = value - self.nodes[i]
        while i:
            self.nodes[i] += change
            i //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The slot that holds the unit at ``place`` (the last slot with any, at the end) and the units before it."""
        if place >= self.total:
            place = max(0, self.total - 1)
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place - before >= self.nodes[i]:
                before += self.nodes[i]
                i += 1
        return i - self.size, before


@dataclass
class Document:
    """A text as leaf slots with sums of characters and tokens; slots may be empty."""
    count: Callable[[str], int]
    slots: list[str]
    chars: SumTree
    tokens: SumTree
    encoded: int = field(default=0)

    @classmethod
    def build(cls, text: str, count: Callable[[str], int]) -> Document:
        slots = leaves_of(text)
        return cls(count, slots, SumTree.of([len(s) for s in slots]), SumTree.of([count(s) for s in slots]))

    @classmethod
    def restore(cls, text: str, leaf_chars: list[int], leaf_tokens: list[int], count: Callable[[str], int]) -> Document:
        """From sums that were kept: nothing is encoded."""
        slots, at = [], 0
        for n in leaf_chars:
            slots.append(text[at:at + n])
            at += n
        return cls(count, slots, SumTree.of(list(leaf_chars)), SumTree.of(list(leaf_tokens)))

    def put(self, slot: int, text: str, tokens: int) -> None:
        self.slots[slot] = text
        self.chars.set(slot, len(text))
        self.tokens.set(slot, tokens)

    def edit(self, place: int, taken: int, new: str) -> None:
        """Replaces ``taken`` characters at ``place`` by ``new``; both are clipped to the text."""
        place = max(0, min(place, self.chars.total))
        taken = max(0, min(taken, self.chars.total - place))
        first, before = self.chars.find(place)
        last, _ = self.chars.find(place + taken - 1) if taken else (first, before)
        text = "".join(self.slots[first:last + 1])
        text = text[:place - before] + new + text[place - before + taken:]
        for k in range(first + 1, last + 1):
            self.put(k, "", 0)
        # take in neighbours until the cuts on both sides hold again
        left = first - 1
        while left >= 0 and (not self.slots[left] or not holds(self.slots[left], text)):
            if self.slots[left]:
                text = self.slots[left] + text
                self.put(left, "", 0)
            left -= 1
        right = last + 1
        while right < len(self.slots) and (not self.slots[right] or not holds(text, self.slots[right])):
            if self.slots[right]:
                text += self.slots[right]
                self.put(right, "", 0)
            right += 1
        self.encoded += len(text)
        self.put(first, text, self.count(text))
        if len(text) > 64 * LEAF:
            self.split()

    def split(self) -> None:
        """Leaves that edits made long are cut anew; the others keep their counts."""
        chars, tokens, slots = [], [], []
        for k, s in enumerate(self.slots):
            parts = leaves_of(s) if len(s) > 64 * LEAF else [s] if s else []
            slots += parts
            chars += [len(p) for p in parts]
            tokens += [self.tokens.nodes[self.tokens.size + k]] if len(parts) == 1 else [self.count(p) for p in parts]
        self.slots = slots or [""]
        self.chars, self.tokens = SumTree.of(chars or [0]), SumTree.of(tokens or [0])

    @property
    def text(self) -> str:
        return "".join(self.slots)

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        kept = [k for k, s in enumerate(self.slots) if s]
        return [len(self.slots[k]) for k in kept], [self.tokens.nodes[self.tokens.size + k] for k in kept]


TREE = "leaf_chars array<int>, leaf_tokens array<int>"


def shared_ranks(spark: SparkSession, vocabulary: str):
    return spark.sparkContext.broadcast(load_ranks(vocabulary))


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the leaves of each row's tree; null text is empty and has no leaf."""
    ranks = shared_ranks(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, ranks.value)
        for b in batches:
            made = [Document.build(t.as_py(), count) for t in b.column("text")]
            sums = [d.leaf_sums() for d in made]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([d.tokens.total for d in made], pa.int64()), pa.array([s[0] for s in sums], pa.list_(pa.int32())), pa.array([s[1] for s in sums], pa.list_(pa.int32()))],
                ["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"])

    return texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {TREE}")


def edited(docs: DataFrame, kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents after their edits: ``doc_id``, ``text``, ``n_tokens``, ``n_edits``, ``n_encoded`` (characters encoded
    again) and the new tree. ``kept``: ``trees`` of the documents as they were; ``edits``: ``doc_id``, ``seq``,
    ``place``, ``taken``, ``new``, applied by ``seq``, each to the text the one before left (ties: by place and text).

    Documents without edits come out as they are. Ids must name one document: of repeated rows each takes the
    edits. Edits of a null or unknown id have no effect; nulls in an edit are 0 and the empty text."""
    ranks = shared_ranks(docs.sparkSession, vocabulary)
    change = F.struct(F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("place", F.lit(0)).cast("int").alias("place"),
                      F.coalesce("taken", F.lit(0)).cast("int").alias("taken"), F.coalesce("new", F.lit("")).alias("new"))
    per_doc = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(change)).alias("edits"))
    rows = texts(docs).join(kept.select("doc_id", "leaf_chars", "leaf_tokens").dropDuplicates(["doc_id"]), "doc_id", "left").join(per_doc, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, ranks.value)
        for b in batches:
            out = []
            for r in b.to_pylist():
                d = Document.build(r["text"], count) if r["leaf_chars"] is None else Document.restore(r["text"], r["leaf_chars"] or [0], r["leaf_tokens"] or [0], count)
                for e in r["edits"] or ():
                    d.edit(e["place"], e["taken"], e["new"])
                chars, tokens = d.leaf_sums()
                out.append({"doc_id": r["doc_id"], "text": d.text, "n_tokens": d.tokens.total, "n_edits": len(r["edits"] or ()), "n_encoded": d.encoded, "leaf_chars": chars, "leaf_tokens": tokens})
            yield pa.RecordBatch.from_pylist(out, OUT)

    return rows.mapInArrow(run, f"doc_id long, text string, n_tokens long, n_edits long, n_encoded long, {TREE}")


OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_encoded", pa.int64()),
                 ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))])

_NUMBER = re.compile(r"[0-9]{3,}")


def masked_numbers(text: str) -> list[Edit]:
    """Edits that put one 0 in place of every run of three digits or more, from the end so that places stay."""
    return [(m.start(), m.end() - m.start(), "0") for m in _NUMBER.finditer(text)][::-1]


def counts_before_and_after(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = masked_numbers, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``n_leaves``, ``n_edits``, ``n_tokens_after`` and ``n_encoded``,
    the characters that the edits made the tree encode again. Edits follow from the text, so texts stay in their task."""
    ranks = shared_ranks(docs.sparkSession, vocabulary)
    names = ["doc_id", "n_tokens", "n_leaves", "n_edits", "n_tokens_after", "n_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, ranks.value)
        for b in batches:
            rows = []
            for t in b.column("text"):
                text = t.as_py()
                d = Document.build(text, count)
                before, edits = d.tokens.total, edits_of(text)
                for e in edits:
                    d.edit(*e)
                rows.append((before, sum(map(bool, d.slots)), len(edits), d.tokens.total, d.encoded))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]], names)

    return texts(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
