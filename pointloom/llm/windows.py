"""Repeated passages: what operators 4 and 6 share.

Both remove every item (word or byte) covered by a window of 50 items that also starts in a document with a
smaller id. A window is never shuffled by itself. Each window holds a *minimizer*: the gram of ``k`` items
with the least hash, the same wherever the window stands, about two for every 36 items. The work is
a chain of Spark jobs over these:

1. ``repeated``  every group of documents sends the minimizer hashes it holds to buckets by hash; a bucket
   answers each group with those that occur in two documents or more.
2. ``occurrences``  places of repeated minimizers, with the hash of the *context*: all items that a window
   around the place can hold. Buckets find the first document of every context. First places of minimizers with
   two contexts or more go on.
3. ``pieces``  their items, dealt to shards by minimizer, where the operator's own index finds the windows
   that also start in an earlier document.
4. Later places of a context have their windows in its first document. With a ``stream`` (operator 4) that is only
   a route: the shard of the first document indexes its passages, the later documents' passages are streamed
   through that index, and what it finds counts. Without one (operator 6) such a place is done.
5. ``judged``  the marks and the texts of a group of documents meet, once, and give the result rows.

Groups are pmod(hash(doc_id, text)), so no key of the data decides a group's size. Rows in 1 to 3 are packed
arrays. Hot minimizers (over HOT documents) have their contexts spread over all buckets. Their windows go to
shards by two hashes, the least id of each window in a group alone, so no bucket or shard grows with one passage. The
passages streamed to a first document are dealt over copies of its passage, one for about eight groups that ask.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix, release, run_hash, sliding, stage

WINDOW = 50
GROUP_BYTES = 12 << 20
HOT = 4096
#: A minimizer with more contexts than this is treated like a hot one, so that a shard's index stays small.
CROWDED = 1000
CHUNK = 1 << 17
#: Streamed passages are cut before one minimizer of CUT_EVERY, chosen by its hash, so that copies are cut alike; where
#: that leaves more items than SEGMENT, into segments that overlap by a window less one.
CUT_EVERY, SEGMENT = np.uint64(8), 256
#: Groups that ask for one context from one copy of its first passage.
ASKERS = 8
_OTHER = np.uint64(0xD6E8FEB86659FD93)
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Unit:
    """How a text is cut into items."""

    k: int
    source: Callable[[bytes], object]  # a text's sequence of items
    hashes: Callable[[object], np.ndarray]
    cut: Callable[[object, int, int], bytes]  # bytes of a run of items


# --- numpy kernels -------------------------------------------------------------------------------


def minimizers(h: np.ndarray, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimizers of one document's items, chunk by chunk."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, values = [], []
    for a in range(0, n - window + 1, CHUNK):
        part = h[a : a + CHUNK + window - 1]  # every window is whole in one chunk
        p = prefix(part)
        g = mix((p[k:] - p[:-k]) * powers(len(part))[0][: len(part) - k + 1])
        w = window - k + 1
        low = sliding(np.minimum, g, w)
        pad = np.zeros(w - 1, np.uint64)
        chosen = np.flatnonzero(sliding(np.maximum, np.concatenate((pad, low, pad)), w) == g)
        places.append(chosen + a)
        values.append(g[chosen])
    if len(places) == 1:
        return places[0], values[0]
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(values)[first]


def contexts(h: np.ndarray, places: np.ndarray, k: int, window: int = WINDOW) -> np.ndarray:
    """Hash of all items that windows around each place can hold, and of where the place lies in them."""
    n, reach = len(h), window - k
    out = np.zeros(len(places), np.uint64)
    for i in range(0, len(places), 1 << 13):
        some = places[i : i + (1 << 13)]
        a, b = np.maximum(some - reach, 0), np.minimum(some + window, n)
        base = int(a[0])
        p = prefix(h[base : int(b.max())])
        out[i : i + (1 << 13)] = mix(run_hash(p, a - base, b - base) + (some - a).astype(np.uint64) * np.uint64(1000003) + (b - a).astype(np.uint64))
    return out


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _dealt(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of each key, by ascending key; the work grows with the keys there are, not with their range."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    cut = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1))
    return [(int(ranked[x]), order[x:y]) for x, y in zip(cut, np.append(cut[1:], len(order)))]


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids (NO_ID for null), texts and order of a group's rows. The order depends on the rows alone."""
    ids = table.column("doc_id").to_pylist()
    texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
    ids = np.array([NO_ID if x is None else x for x in ids], np.int64)
    order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
    return ids, texts, order


def _blob(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


# --- the jobs ------------------------------------------------------------------------------------


def grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // GROUP_BYTES) + 1
    return rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def repeated(rows: DataFrame, n: int, unit: Unit) -> DataFrame:
    """``(grp, keys, hot)``: minimizer hashes of a group that two documents or more hold, sorted."""

    def scan(batches):
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            keys, owners, docs = [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                h = np.unique(minimizers(unit.hashes(unit.source(text or b"")), unit.k)[1])
                if len(h):
                    keys.append(h)
                    owners.append(grp[i])
            if not keys:
                continue
            sizes = [len(x) for x in keys]
            h, g = np.concatenate(keys), np.repeat(np.array(owners, np.int64), sizes)
            b = (h % np.uint64(n)).astype(np.int64)
            order = np.lexsort((h, g, b))
            h, g, b = h[order], g[order], b[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            at = np.flatnonzero(new)
            count = np.minimum(np.diff(np.append(at, len(h))), 65535).astype(np.uint16)
            h, g, b = h[at], g[at], b[at]
            cut = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (g[1:] != g[:-1]))))
            ends = np.append(cut[1:], len(h))
            yield pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array(g[cut], pa.int32()), pa.array([_pack(h[x:y]) for x, y in zip(cut, ends)], pa.binary()), pa.array([_pack(count[x:y]) for x, y in zip(cut, ends)], pa.binary())], ["bucket", "grp", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        sizes = np.array([len(x) // 8 for x in parts])
        h = np.frombuffer(b"".join(parts), np.uint64)
        c = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=c)[inverse]
        keep = total >= 2
        g = np.repeat(table.column("grp").to_numpy(), sizes)[keep]
        h, hot = h[keep], (total[keep] > HOT).view(np.uint8)
        parts = _dealt(g)
        return pa.table({"grp": pa.array([i for i, _ in parts], pa.int32()), "keys": pa.array([_pack(h[s]) for _, s in parts], pa.binary()), "hot": pa.array([_pack(hot[s]) for _, s in parts], pa.binary())})

    sent = rows.select("grp", "text").mapInArrow(scan, "bucket int, grp int, keys binary, counts binary")
    return stage(sent.groupBy("bucket").applyInArrow(answer, "grp int, keys binary, hot binary"), "repeated")


OCCURRENCES = "grp int, bucket int, anchors binary, contexts binary, ids binary, row binary, place binary, item binary, hot binary"


def occurrences(rows: DataFrame, known: DataFrame, n: int, unit: Unit) -> DataFrame:
    """For each group and bucket the distinct contexts (minimizer, context, least id, hot), and under bucket
    -1 where they stand: row of the group, place, number of the context in bucket order."""
    schema = pa.schema([("grp", pa.int32()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("anchors", "contexts", "ids", "row", "place", "item", "hot")])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        grp = left.column("grp")[0].as_py()
        keys = _blob(right.column("keys"))
        hot = np.frombuffer(b"".join(right.column("hot").to_pylist()), np.uint8)
        keys, first = np.unique(keys, return_index=True)
        hot = hot[first]
        ids, texts, order = _texts(left)
        found = []
        for row, i in enumerate(order):
            h = unit.hashes(unit.source(texts[i]))
            at, value = minimizers(h, unit.k)
            if len(at):
                where = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                hit = keys[where] == value
                if hit.any():
                    at = at[hit]
                    found.append((np.full(len(at), row), np.full(len(at), ids[i]), at, value[hit], contexts(h, at, unit.k), hot[where[hit]]))
        if not found:
            return schema.empty_table()
        row, doc, at, anchor, context, warm = (np.concatenate(x) for x in zip(*found))
        b = (np.where(warm > 0, mix(anchor ^ context), anchor) % np.uint64(n)).astype(np.int64)
        o = np.lexsort((doc, context, anchor, b))
        new = np.concatenate(([True], (anchor[o][1:] != anchor[o][:-1]) | (context[o][1:] != context[o][:-1])))
        item = np.empty(len(o), np.int32)
        item[o] = np.cumsum(new) - 1
        head = o[new]
        out = [{"grp": grp, "bucket": i, "anchors": _pack(anchor[s]), "contexts": _pack(context[s]), "ids": _pack(doc[s]), "hot": _pack(warm[s])} for i, at_ in _dealt(b[head]) for s in [head[at_]]]
        by_place = np.lexsort((at, row))
        out.append({"grp": grp, "bucket": -1, "row": _pack(row[by_place].astype(np.int32)), "place": _pack(at[by_place].astype(np.int32)), "item": _pack(item[by_place])})
        return pa.Table.from_pylist(out, schema)

    return stage(rows.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(find, OCCURRENCES), "places")


def first_contexts(places: DataFrame) -> DataFrame:
    """``(grp, bucket, first, status, anchors)`` for each group's contexts in a bucket, in their order: the
    least id of the context and a status. Its two low bits are 1 if this group's piece goes on to a shard (2: of a hot
    minimizer), the third is set if several groups hold the context, four count the doublings of its copies (32,768 at
    most, which then serve more groups each), the last is set where passages are cut."""

    def answer(table: pa.Table) -> pa.Table:
        sizes = np.array([len(x) // 8 for x in table.column("anchors").to_pylist()])
        anchor, context = _blob(table.column("anchors")), _blob(table.column("contexts"))
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        hot = np.frombuffer(b"".join(table.column("hot").to_pylist()), np.uint8)
        grp = np.repeat(table.column("grp").to_numpy(), sizes)
        o = np.lexsort((grp, ids, context, anchor))
        a, c = anchor[o], context[o]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new_c = new_a | np.concatenate(([True], c[1:] != c[:-1]))
        first = np.empty(len(o), np.int64)
        first[o] = ids[o][np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
        many = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_a))[np.cumsum(new_a) - 1]
        go = np.zeros(len(o), np.uint8)
        go[o] = (ids[o] == first[o]) & ((many > 1) | (hot[o] > 0))
        crowd = np.empty(len(o), bool)
        crowd[o] = many > CROWDED
        go[(go > 0) & ((hot > 0) | crowd)] = 2
        groups = np.empty(len(o), np.int64)  # each sends a context once
        groups[o] = np.diff(np.append(np.flatnonzero(new_c), len(o)))[np.cumsum(new_c) - 1]
        spread = np.minimum(np.frexp((groups // ASKERS).astype(np.float64))[1].astype(np.int64), 15)
        cut = (mix(anchor ^ _OTHER) % CUT_EVERY == 0).astype(np.int64)
        go |= ((groups > 1).astype(np.int64) << 2 | spread << 3 | cut << 7).astype(np.uint8)
        ends = np.cumsum(sizes)
        spans = list(zip(ends - sizes, ends))
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "first": pa.array([_pack(first[x:y]) for x, y in spans], pa.binary()), "status": pa.array([_pack(go[x:y]) for x, y in spans], pa.binary()), "anchors": table.column("anchors")})

    sent = places.filter("bucket >= 0").select("bucket", "grp", "anchors", "contexts", "ids", "hot")
    return sent.groupBy("bucket").applyInArrow(answer, "grp int, bucket int, first binary, status binary, anchors binary")


def marks(rows_of: DataFrame, answers: DataFrame) -> DataFrame:
    """``(grp, row, place, done, status, anchor)``: packed, one row for each group."""
    schema = "grp int, row binary, place binary, item binary, first binary, status binary, anchors binary"

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int32() if "int" in x else pa.binary()) for x in schema.split(", ")})
        right = right.sort_by("bucket")
        join_up = lambda c: b"".join(right.column(c).to_pylist())
        one = left.select(["grp", "row", "place", "item"])
        return pa.table({"grp": one.column("grp"), "row": one.column("row"), "place": one.column("place"), "item": one.column("item"), "first": pa.array([join_up("first")], pa.binary()), "status": pa.array([join_up("status")], pa.binary()), "anchors": pa.array([join_up("anchors")], pa.binary())})

    return stage(rows_of.filter("bucket < 0").groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(join, schema), "marks")


PIECES = "shard int, grp int, kind int, contexts binary, starts binary, ids binary, sizes binary, holds binary, items binary, windows binary, checks binary"
#: Kinds of packed rows: pieces for the shard's index, windows of hot minimizers by hash, ranges already found,
#: passages of first documents, segments of later ones.
PIECE, HASHED, DONE, PASSAGE, ASKED = 0, 1, 2, 3, 4


def _stretches(row: np.ndarray, begin: np.ndarray, end: np.ndarray, *alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of ranges, in order of row and begin: a stretch goes on while ranges overlap and
    all of ``alike`` stay the same."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    for x in alike:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(row)) - 1


def segments(row, place, item, first, status, doc, reach: int, window: int) -> tuple[np.ndarray, ...]:
    """``(row, begin, end, first, spread)`` of the segments a group asks for: stretches of places whose context stands
    first in one earlier document. Ends may pass the text's."""
    later = np.flatnonzero(doc > first[item])
    r, p, f, s = row[later], place[later], first[item[later]], status[item[later]] >> 3 & 15
    begin, end = np.maximum(p - reach, 0), p + window
    head, last = _stretches(r, begin, end, f, s, np.cumsum(status[item[later]] >> 7, dtype=np.int64))
    step = SEGMENT - window + 1
    n = np.maximum(-(-(end[last] - begin[head] - window + 1) // step), 1)
    at = np.repeat(np.arange(len(head)), n)
    low = begin[head][at] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    return r[head][at], low, np.minimum(low + SEGMENT, end[last][at]), f[head][at], s[head][at]


def _home(first: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a copy of a first document's passages."""
    return (mix(mix(first.astype(np.uint64)) + salt.astype(np.uint64) * _OTHER) % np.uint64(shards)).astype(np.int64)


def pieces(rows: DataFrame, marked: DataFrame, shards: int, unit: Unit, streamed: bool, window: int = WINDOW) -> DataFrame:
    """The items around one place of every context that goes on, packed by group and shard. Of hot minimizers
    the single windows go by hash: the least id of each in the group is sent on, the others are done."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = {x.split()[0]: pa.int32() if x.endswith("int") else pa.binary() for x in PIECES.split(", ")}
    reach = window - unit.k

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], kinds[c]) for c in names})
        grp = left.column("grp")[0].as_py()
        get = lambda c, t: np.frombuffer(right.column(c)[0].as_py(), t)
        row, place, item = get("row", np.int32), get("place", np.int32), get("item", np.int32)
        first, status, anchor = get("first", np.int64), get("status", np.uint8), get("anchors", np.uint64)
        ids, texts, order = _texts(left)
        doc = ids[order][row]
        go = np.flatnonzero((status[item] & 3 > 0) & (doc == first[item]))
        # one place speaks for all of its context
        go = np.sort(go[np.unique(item[go], return_index=True)[1]])
        shard, context, size, hold, items = [], [], [], [], []
        hot: list[tuple] = []
        at = 0
        while at < len(go):
            r = row[go[at]]
            end = at + int(np.searchsorted(row[go[at:]], r, side="right"))
            some = go[at:end]
            source = unit.source(texts[order[r]])
            a, b = np.maximum(place[some] - reach, 0), np.minimum(place[some] + window, len(source))
            cold = status[item[some]] & 3 == 1
            shard.append((mix(anchor[item[some]]) % np.uint64(shards)).astype(np.int64)[cold])
            context.append(some[cold])
            size.append((b - a)[cold])
            hold.append((place[some] - a)[cold])
            items += [unit.cut(source, x, y) for x, y in zip(a[cold].tolist(), b[cold].tolist())]
            if not cold.all():
                h = unit.hashes(source)
                for j, x, y in zip(some[~cold].tolist(), a[~cold].tolist(), b[~cold].tolist()):
                    starts = np.arange(y - x - window + 1)
                    one, two = (run_hash(prefix(v), starts, starts + window) for v in (h[x:y], mix(h[x:y] ^ _OTHER)))
                    hot.append((np.full(len(starts), j), starts, one, two))
            at = end
        made = {c: [] for c in names}

        def add(shard, kind, **columns):
            for c in names:
                made[c].append({"shard": shard, "grp": grp, "kind": kind}.get(c, columns.get(c)))

        if items:
            shard, context, size, hold = (np.concatenate(x) for x in (shard, context, size, hold))
            for x, s in _dealt(shard):
                add(x, PIECE, contexts=_pack(item[context[s]]), ids=_pack(doc[context[s]]), starts=_pack(np.zeros(len(s), np.int32)), sizes=_pack(size[s].astype(np.int32)), holds=_pack(hold[s].astype(np.int32)), items=b"".join([items[i] for i in s]))
        if hot:
            j, start, key, check = (np.concatenate(x) for x in zip(*hot))
            o = np.lexsort((doc[j], check, key))
            j, start, key, check = j[o], start[o], key[o], check[o]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
            least = doc[j][new][np.cumsum(new) - 1]
            done = doc[j] > least
            if done.any():
                add(grp % shards, DONE, contexts=_pack(item[j[done]]), starts=_pack(start[done].astype(np.int32)))
            j, start, key, check = j[~done], start[~done], key[~done], check[~done]
            for x, s in _dealt((key % np.uint64(shards)).astype(np.int64)):
                add(x, HASHED, contexts=_pack(item[j[s]]), starts=_pack(start[s].astype(np.int32)), ids=_pack(doc[j[s]]), windows=_pack(key[s]), checks=_pack(check[s]))
        if streamed:
            # passages of first documents that other documents, here or elsewhere, ask for
            asked = (status >> 2 & 1).astype(bool)
            asked[item[doc > first[item]]] = True
            mine = np.flatnonzero((doc == first[item]) & asked[item])
            mine = np.sort(mine[np.unique(item[mine], return_index=True)[1]])
            spread = status[item[mine]] >> 3 & 15
            begin, end = np.maximum(place[mine] - reach, 0), place[mine] + window
            head, last = _stretches(row[mine], begin, end, spread)
            copies = np.int64(1) << spread[head].astype(np.int64)
            at = np.repeat(np.arange(len(head)), copies)
            salt = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            r, a, b = row[mine][head], begin[head], end[last]
            send = [(PASSAGE, r, a, b, at, _home(doc[mine][head][at], salt, shards), doc[mine][head])]
            r, a, b, f, spread = segments(row, place, item, first, status, doc, reach, window)
            send.append((ASKED, r, a, b, np.arange(len(r)), _home(f, grp % (np.int64(1) << spread.astype(np.int64)), shards), f))
            for kind, r, a, b, at, shard, f in send:
                parts, sizes = [b""] * len(r), np.zeros(len(r), np.int32)
                bounds = np.searchsorted(r, np.arange(len(order) + 1))
                for i in np.unique(r):
                    source = unit.source(texts[order[i]])
                    for j in range(bounds[i], bounds[i + 1]):
                        parts[j] = unit.cut(source, int(a[j]), int(b[j]))
                        sizes[j] = min(int(b[j]), len(source)) - int(a[j])
                at, shard = at[sizes[at] >= window], shard[sizes[at] >= window]
                for x, s in _dealt(shard):
                    add(x, kind, contexts=_pack(at[s].astype(np.int32)), starts=_pack(np.zeros(len(s), np.int32)), ids=_pack(ids[order[r[at[s]]]]), sizes=_pack(sizes[at[s]]), holds=_pack(np.array([len(parts[j]) for j in at[s]], np.int32)), windows=_pack(f[at[s]]), items=b"".join([parts[j] for j in at[s]]))
        return pa.table({c: pa.array(made[c], kinds[c]) for c in names})

    return rows.groupBy("grp").cogroup(marked.groupBy("grp")).applyInArrow(cut, PIECES)


FOUND = "grp int, streamed boolean, contexts binary, starts binary, ends binary"


def matched(sent: DataFrame, resolve: Callable[[list, np.ndarray, np.ndarray, np.ndarray], tuple], stream: Callable | None, window: int = WINDOW) -> DataFrame:
    """Item ranges of contexts (``streamed``: of segments), counted from their start, whose windows start in an earlier
    document too. ``resolve(items, sizes, ids, holds)`` gets one shard's pieces (``holds``: where in each the minimizer
    stands) and returns (piece, start, end) arrays. ``stream(items, sizes, ids, asked, lengths, owners)`` gets a shard's
    passages and the segments asked for and returns (segment, start, end). Equal segments that ask for one document are
    streamed once, for the least of their ids: all of them come after that document."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        found, streamed = [], []
        none = np.zeros(0, np.int64)
        for what in (PIECE, HASHED, DONE, ASKED):
            some = table.filter(pa.array(kind == what))
            if not some.num_rows:
                continue
            join_up = lambda c, t: np.frombuffer(b"".join(some.column(c).to_pylist()), t)  # noqa: B023, E731
            counts = np.array([len(x) // 4 for x in some.column("contexts").to_pylist()])
            grp = np.repeat(some.column("grp").to_numpy(), counts)
            context, start = join_up("contexts", np.int32), join_up("starts", np.int32)
            if what == ASKED:
                first = table.filter(pa.array(kind == PASSAGE))
                of = lambda c, t: np.frombuffer(b"".join(first.column(c).to_pylist()), t)  # noqa: B023, E731
                ids, asks = join_up("ids", np.int64), join_up("windows", np.int64).tolist()
                distinct: dict[tuple, int] = {}
                at = 0
                which = np.empty(len(ids), np.int64)
                for blob, sizes in zip(some.column("items").to_pylist(), some.column("holds").to_pylist()):
                    x = 0
                    for y in np.cumsum(np.frombuffer(sizes, np.int32)).tolist():
                        which[at] = distinct.setdefault((asks[at], blob[x:y]), len(distinct))
                        x, at = y, at + 1
                alike = np.argsort(which, kind="stable")
                cut = np.searchsorted(which[alike], np.arange(len(distinct) + 1))
                one, a, b = stream(first.column("items").to_pylist(), of("sizes", np.int32), of("ids", np.int64), [x for _, x in distinct], join_up("sizes", np.int32)[alike[cut[:-1]]], np.minimum.reduceat(ids[alike], cut[:-1]))
                n = cut[one + 1] - cut[one]
                piece = alike[np.repeat(cut[one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                streamed.append((grp[piece], context[piece], np.repeat(a, n), np.repeat(b, n)))
                continue
            if what == PIECE:
                piece, a, b = resolve(some.column("items").to_pylist(), join_up("sizes", np.int32), join_up("ids", np.int64), join_up("holds", np.int32))
                found.append((grp[piece], context[piece], a, b))
                continue
            hit = np.ones(len(start), bool)
            if what == HASHED:
                key, check, ids = join_up("windows", np.uint64), join_up("checks", np.uint64), join_up("ids", np.int64)
                o = np.lexsort((ids, check, key))
                new = np.concatenate(([True], (key[o][1:] != key[o][:-1]) | (check[o][1:] != check[o][:-1])))
                hit[o] = ids[o] > ids[o][new][np.cumsum(new) - 1]
            found.append((grp[hit], context[hit], start[hit], start[hit] + window))
        made = {"grp": [], "streamed": [], "contexts": [], "starts": [], "ends": []}
        for flag, parts in ((False, found), (True, streamed)):
            grp, context, a, b = (np.concatenate(x) for x in zip(*parts, (none,) * 4))
            for x, s in _dealt(grp):
                made["grp"].append(x)
                made["streamed"].append(flag)
                for c, v in (("contexts", context), ("starts", a), ("ends", b)):
                    made[c].append(_pack(v[s].astype(np.int32)))
        return pa.table({"grp": pa.array(made["grp"], pa.int32()), "streamed": pa.array(made["streamed"], pa.bool_()), **{c: pa.array(made[c], pa.binary()) for c in ("contexts", "starts", "ends")}})

    return stage(sent.groupBy("shard").applyInArrow(run, FOUND), "found")


def judged(rows: DataFrame, marked: DataFrame, found: DataFrame, unit: Unit, schema: str, report: Callable, streamed: bool, window: int = WINDOW) -> DataFrame:
    """``report(text, source, n, spans)`` of every document row, spans being its maximal removed item runs."""
    reach = window - unit.k
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}.get(x.split(maxsplit=1)[1], pa.list_(pa.int64())) for x in schema.split(", ")}
    nothing = F.lit(None).cast("binary")
    a = marked.select("grp", F.lit(False).alias("streamed"), "row", "place", "item", "first", "status", nothing.alias("starts"), nothing.alias("ends"))
    b = found.select("grp", "streamed", nothing.alias("row"), nothing.alias("place"), F.col("contexts").alias("item"), nothing.alias("first"), nothing.alias("status"), "starts", "ends")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], kinds[c]) for c in names})
        ids, texts, order = _texts(left)
        row = start = end = np.zeros(0, np.int64)
        parts = right.to_pylist()
        for x in (x for x in parts if x["place"] is not None):  # one at most
            row, place, item = (np.frombuffer(x[c], np.int32) for c in ("row", "place", "item"))
            first = np.frombuffer(x["first"], np.int64)[item]
            doc, begin = ids[order][row], np.maximum(place - reach, 0)
            done = doc > first if not streamed else np.zeros(len(doc), bool)
            mine = np.flatnonzero(doc == first)
            mine = mine[np.argsort(item[mine], kind="stable")]
            here = item[mine]
            rows_, starts_, ends_ = [row[done]], [begin[done]], [place[done] + window]
            if streamed:
                sent_row, sent_begin = segments(row, place, item, np.frombuffer(x["first"], np.int64), np.frombuffer(x["status"], np.uint8), doc, reach, window)[:2]
            for y in (y for y in parts if y["place"] is None):
                got, s, e = (np.frombuffer(y[c], np.int32) for c in ("item", "starts", "ends"))
                if y["streamed"]:
                    rows_.append(sent_row[got])
                    starts_.append(sent_begin[got] + s)
                    ends_.append(sent_begin[got] + e)
                    continue
                low, high = np.searchsorted(here, got), np.searchsorted(here, got, side="right")
                n = high - low
                at = mine[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                rows_.append(row[at])
                starts_.append(begin[at] + np.repeat(s, n))
                ends_.append(begin[at] + np.repeat(e, n))
            row, start, end = (np.concatenate(v).astype(np.int64) for v in (rows_, starts_, ends_))
            o = np.lexsort((start, row))
            row, start, end = row[o], start[o], end[o]
        made = {c: [] for c in names}
        bounds = np.searchsorted(row, np.arange(len(order) + 1))
        for r, i in enumerate(order):
            source = unit.source(texts[i])
            n = len(source)
            s, e = start[bounds[r] : bounds[r + 1]], np.minimum(end[bounds[r] : bounds[r + 1]], n)
            if len(s):
                top = np.maximum.accumulate(e)
                new = np.concatenate(([True], s[1:] > top[:-1]))
                s, e = s[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]
            made["doc_id"].append(None if ids[i] == NO_ID else int(ids[i]))
            for c, v in zip(names[1:], report(source, n, s, e)):
                made[c].append(v)
        return pa.table({c: pa.array(made[c], kinds[c]) for c in names})

    return rows.groupBy("grp").cogroup(a.unionByName(b).groupBy("grp")).applyInArrow(run, schema)


def deduplicated(docs: DataFrame, unit: Unit, resolve: Callable, schema: str, report: Callable, shards_a_group: int, stream: Callable | None = None) -> DataFrame:
    """One row of ``schema`` for every row of ``docs``. Null texts count as empty; rows without an id are one document
    that comes last; rows of one id never remove each other; an empty table gives no rows; columns beside doc_id and
    text are ignored."""
    rows, n = grouped(docs)
    known = repeated(rows, n, unit)
    places = occurrences(rows, known, n, unit)
    release(known)
    marked = marks(places, first_contexts(places))
    release(places)
    streamed = stream is not None
    found = matched(pieces(rows, marked, shards_a_group * n, unit, streamed), resolve, stream)
    return judged(rows, marked, found, unit, schema, report, streamed)
