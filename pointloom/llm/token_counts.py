"""Operator 8: edit-aware token counts.

A document's pre-tokens are kept in blocks; a segment tree over the blocks holds characters and tokens. An
edit finds its blocks by descending the character sums, splits only their text again, starting at the first
pre-token the edit can change and ending where old and new pre-tokens fall together again, encodes what is
new, and updates the sums on the way to the root. A pre-token depends on its own text and at most
two characters after it (of white space, the last character goes to the word that follows), so those are all
the context needed on the left; on the right, splitting runs on until a boundary meets an old one.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .tokens import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 64
LARGEST_BLOCK = 512
PIECES_KEPT, LONGEST_KEPT = 300_000, 200
#: Fixed value: the pattern of the public vocabulary, which splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EDITS = "array<struct<at:int,cut:int,put:string>>"


class Counter(dict):
    """Tokens of pre-tokens, remembered up to a bound."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        value = len(self.encode(piece))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = value
        return value

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


_loaded: dict[str, Counter] = {}


def loaded(path: str) -> Counter:
    """One vocabulary for all tasks of a Python worker."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


class CountTree:
    """Segment tree over blocks of pre-tokens: characters and tokens below every node. A block is its text and
    the lengths and token counts of its pre-tokens (splitting it alone could differ at its end)."""

    def __init__(self, counter: Counter, blocks: list[str], sizes: list[list[int]], counts: list[list[int]]):
        self.counter, self.reencoded = counter, 0
        self._index(blocks, sizes, counts)

    def _index(self, blocks: list[str], sizes: list[list[int]], counts: list[list[int]]) -> None:
        """Sums over the blocks; nothing is split or encoded."""
        self.blocks, self.sizes, self.counts = blocks, sizes, counts
        self.width = 1 << max(len(blocks) - 1, 0).bit_length()
        pad = [0] * (self.width - len(blocks))
        self.chars = [0] * self.width + list(map(len, blocks)) + pad
        self.tokens = [0] * self.width + list(map(sum, counts)) + pad
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    @classmethod
    def of(cls, counter: Counter, text: str) -> CountTree:
        pieces = counter.split(text)
        parts = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        return cls(counter, ["".join(p) for p in parts], [list(map(len, p)) for p in parts], [counter.counts(p) for p in parts])

    @classmethod
    def stored(cls, counter: Counter, text: str, sizes: list[int], counts: list[int], in_block: list[int]) -> CountTree:
        """The tree of a row of :func:`build`."""
        blocks, parts, tokens, i, place = [], [], [], 0, 0
        for n in in_block:
            part = sizes[i : i + n]
            end = place + sum(part)
            blocks.append(text[place:end])
            parts.append(part)
            tokens.append(counts[i : i + n])
            i, place = i + n, end
        return cls(counter, blocks, parts, tokens)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, block: int, text: str, sizes: list[int], counts: list[int]) -> None:
        self.blocks[block], self.sizes[block], self.counts[block] = text, sizes, counts
        i = self.width + block
        self.chars[i], self.tokens[i] = len(text), sum(counts)
        while i > 1:
            i //= 2
            self._sum(i)

    def find(self, at: int) -> tuple[int, int]:
        """Block that holds the character at a place (the last block with text for the end), and its start."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` characters from ``at`` on by ``put``; places beyond the text count as its end."""
        total = self.chars[1]
        at = min(max(at, 0), total)
        cut = min(max(cut, 0), total - at)
        first, start = self.find(max(at - 2, 0))  # a pre-token that ends here can change its end
        last = max(first, self.find(min(at + cut, max(total - 1, 0)))[0])
        old, sizes = "".join(self.blocks[first : last + 1]), [n for part in self.sizes[first : last + 1] for n in part]
        known = [n for part in self.counts[first : last + 1] for n in part]
        local, shift = at - start, len(put) - cut
        kept, done = 0, 0
        # up to two characters after a pre-token decide on its end: those that end before them stand
        while kept < len(sizes) and done + sizes[kept] + 1 < local:
            done += sizes[kept]
            kept += 1
        while True:
            fresh = old[:local] + put + old[local + cut :]
            bounds, place = {}, 0
            for i, n in enumerate(sizes):
                place += n
                if place >= local + cut:
                    bounds[place + shift] = i + 1
            pieces, place, rest, after = [], done, None, []
            for piece in self.counter.split(fresh[done:]):
                pieces.append(piece)
                place += len(piece)
                if place in bounds and local + len(put) <= place < len(fresh) - 1:
                    rest, after = sizes[bounds[place] :], known[bounds[place] :]
                    break
            if rest is not None or last + 1 >= len(self.blocks):
                break
            last += 1  # no boundary met: take the next block in
            old += self.blocks[last]
            sizes += self.sizes[last]
            known += self.counts[last]
        self.reencoded += sum(map(len, pieces))
        whole = sizes[:kept] + list(map(len, pieces)) + (rest or [])
        counts = known[:kept] + self.counter.counts(pieces) + after
        if len(whole) <= LARGEST_BLOCK:
            self._set(first, fresh, whole, counts)
            for block in range(first + 1, last + 1):
                self._set(block, "", [], [])
            return
        # too large for one block: cut in place into blocks of BLOCK pre-tokens, then sum up anew
        texts, place = [], 0
        for i in range(0, len(whole), BLOCK):
            end = place + sum(whole[i : i + BLOCK])
            texts.append(fresh[place:end])
            place = end
        cut_up = lambda x: [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
        put_in = lambda old, new: old[:first] + new + old[last + 1 :]
        self._index(put_in(self.blocks, texts), put_in(self.sizes, cut_up(whole)), put_in(self.counts, cut_up(counts)))

    @property
    def text(self) -> str:
        return "".join(self.blocks)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[str, list[int], list[int], list[int], list[int]]:
        flat = lambda parts: [n for part in parts for n in part]
        return self.text, flat(self.sizes), flat(self.counts), list(map(len, self.sizes)), self.tokens[self.width : self.width + len(self.blocks)]


LEAVES = "text string, piece_chars array<int>, piece_tokens array<int>, block_pieces array<int>, block_tokens array<int>"
LEAF_TYPES = [pa.string()] + [pa.list_(pa.int32())] * 4


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def build(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, text, piece_chars, piece_tokens, block_pieces, block_tokens)``: the leaves of every row's tree.
    Null and empty texts have one empty block. Null or repeated doc_ids stay; empty tables give no rows;
    other columns are ignored, except ``edits``, if it is a list of places, lengths and texts."""
    vocabulary = vocabulary or vocabulary_path(VOCABULARY)
    kind = docs.schema["edits"].dataType if "edits" in docs.columns else None
    with_edits = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == ["at", "cut", "put"]
    schema = f"doc_id long, n_tokens long, {LEAVES}"
    names = _names(schema)

    def run(batches):
        counter = loaded(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                trees = [CountTree.of(counter, t or "") for t in part.column("text").to_pylist()]
                leaves = list(zip(*(t.leaves() for t in trees)))
                arrays = [part.column("doc_id"), pa.array([t.total for t in trees], pa.int64()), *map(pa.array, leaves, LEAF_TYPES)]
                yield pa.RecordBatch.from_arrays(arrays + ([part.column("edits")] if with_edits else []), names + ["edits"] * with_edits)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")] + ([F.col("edits").cast(EDITS).alias("edits")] if with_edits else [])
    return docs.select(columns).mapInArrow(run, schema + (f", edits {EDITS}" if with_edits else ""))


def apply_edits(state: DataFrame, vocabulary: str | None = None, with_state: bool = True) -> DataFrame:
    """Apply each row's ``edits`` in order, every place counting in the text the edits before left. Returns
    ``(doc_id, n_tokens_before, n_edits, n_reencoded, n_tokens)``, n_reencoded being the characters encoded
    again, and the new leaves. A null list is empty; null places and lengths count as 0, a null text as
    empty."""
    vocabulary = vocabulary or vocabulary_path(VOCABULARY)
    schema = "doc_id long, n_tokens_before long, n_edits long, n_reencoded long, n_tokens long" + (f", {LEAVES}" if with_state else "")
    names = _names(schema)

    def run(batches):
        counter = loaded(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                made: dict[str, list] = {c: [] for c in names}
                for row in batch.slice(i, 500).to_pylist():
                    tree = CountTree.stored(counter, row["text"], row["piece_chars"], row["piece_tokens"], row["block_pieces"])
                    before, edits = tree.total, row["edits"] or []
                    for e in edits:
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                    values = (row["doc_id"], before, len(edits), tree.reencoded, tree.total)
                    for c, v in zip(names, values + (tree.leaves() if with_state else ())):
                        made[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(made[c], k) for c, k in zip(names, [pa.int64()] * 5 + LEAF_TYPES)], names)

    return state.select(*_names(LEAVES), "doc_id", "edits").mapInArrow(run, schema)


def derived_edits(docs: DataFrame, edits: int = 3) -> DataFrame:
    """``docs`` with edits that its own rows determine: at places hashed from doc_id and text, five
    characters give way to the document's first eight, then to nothing, in turn. Null and empty texts get edits
    at place 0; null ids and repeated rows are treated like others; other columns are left out; an empty table
    gives no rows."""
    size = F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1))

    def one(i):
        place = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), i), size).cast("int")
        return F.struct(place.alias("at"), F.lit(5).alias("cut"), F.when(i % 2 == 0, F.substring("text", 1, 8)).otherwise("").alias("put"))

    return docs.select("doc_id", "text", F.transform(F.sequence(F.lit(0), F.lit(edits - 1)), one).alias("edits"))


def op8_token_counts(spark, sf_dir):
    docs = derived_edits(table(spark, sf_dir, "documents"))
    return apply_edits(build(docs), with_state=False)
