"""Exact substring dedup over documents: suffix positions ranked by distributed prefix doubling.

Ranks of strings of 1, 2, 4 and 8 bytes are the strings themselves as numbers, doubled with numpy at offsets 1, 2 and
4; names of 16 and of half the threshold follow by pairing ranks at growing offsets. Sorting every position of the
corpus at each step would move many times its size, so positions are thinned without loss first: a string of
``min_bytes`` is named by the least half-length rank inside it, which equal strings share.

1. Names found in one document only are unique: their positions leave (Spark shuffle by name, sorted in buckets).
2. The remaining positions, in runs of one name, go to Spark again; each bucket sorts their pairs (rank at the position,
   rank at the position plus half the threshold). Pairs past the threshold are equal strings: all but those of the
   least document are removed. A name in very many documents (a common line in various surroundings) is not sent as
   one group: its strings go to the buckets of their own pairs, from each slice only those of its least document.
3. Per document the removed starts become byte spans.

Both shuffles are combined before they start: a name or a run found in many documents of a slice is sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import slices, stored
from gridrun.llm.jaccard import small

MIN_BYTES = 50
RUN = 32  # starts in one row, a bit each
#: Text bytes that one bucket of names stands for.
BUCKET_BYTES = 64 * 1024 * 1024
KEY_BITS = 48
#: Names in more documents than this, or than one HOT_NAMES-th of all, are sent string by string.
HOT, HOT_NAMES = 1_000, 100_000


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x = (x + b) * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(32)
    return x


def half_ranks(data: np.ndarray, half: int) -> np.ndarray:
    """Rank (64 bits) of the string of ``half`` bytes at every position with room for it; by doubling, ``half`` from 8."""
    rank, length = data.astype(np.uint64), 1
    while length < 8:
        rank = rank[:-length] | (rank[length:] << np.uint64(8 * length))
        length *= 2
    while length < half:
        step = min(length, half - length)
        rank = _mix(rank[:-step], rank[step:])
        length += step
    return rank


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and their lengths."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts], dtype=np.int64)


def named_runs(texts: list, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, lengths, owner, start, count, name)``: runs of at most RUN starts of one name, within one text."""
    half = min_bytes // 2
    data, lengths = _joined(texts)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < min_bytes:
        return data, lengths, none, none, none, none.astype(np.uint64)
    least, length, width = half_ranks(data, half), 1, min_bytes - half + 1
    while length < width:
        step = min(length, width - length)
        least = np.minimum(least[:-step], least[step:])
        length += step
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(least)]
    valid = owner == np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[min_bytes - 1 :]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(least)))
    keep = valid[start]
    start, count = start[keep], count[keep]
    pieces = -(-count // RUN)
    first = np.repeat(start, pieces)
    order = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first + order * RUN
    count = np.minimum(np.repeat(count, pieces) - order * RUN, RUN)
    del ends
    return data, lengths, owner[start].astype(np.int64), start, count, least[start]


def _bits_for(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(6, int(total // BUCKET_BYTES).bit_length())


def shared_names(docs: DataFrame, min_bytes: int, bits: int) -> DataFrame:
    """``doc_id, name`` of the names (their low ``bits + KEY_BITS`` bits) found in two documents or more."""
    mask = np.uint64((1 << min(64, bits + KEY_BITS)) - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            ids = part.column("doc_id").to_numpy()
            _, _, owner, _, _, name = named_runs(texts, min_bytes)
            name = name & mask
            order = np.lexsort((ids[owner], name))
            name, doc = name[order], ids[owner][order]
            new = np.ones(len(name), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            name, doc = name[new], doc[new]
            first = np.ones(len(name), dtype=bool)
            first[1:] = name[1:] != name[:-1]
            many = ~first
            many[:-1] |= ~first[1:]
            # known here: sent as they are, dealt by document
            yield _rows(bucket=(doc[many] & 0xFFFF), doc_id=doc[many], name=name[many].view(np.int64), docs=None, names=None)
            name, doc = name[first], doc[first]
            bucket = (name & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            name, doc, bucket = name[order] >> np.uint64(bits), doc[order], bucket[order]
            table, index = np.unique(doc, return_inverse=True)
            packed = np.ascontiguousarray(name[:, None].view(np.uint8)[:, : KEY_BITS // 8]) if len(name) else np.zeros((0, 6), np.uint8)
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            tails = np.append(heads[1:], len(bucket))
            docs_out, names_out = [], []
            for a, b in zip(heads, tails, strict=True):
                own, at = np.unique(index[a:b], return_inverse=True)
                kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
                docs_out.append(np.int64(len(own)).tobytes() + table[own].tobytes() + at.astype(kind).tobytes())
                names_out.append(packed[a:b].tobytes())
            yield _rows(bucket=bucket[heads], doc_id=None, name=None, docs=docs_out, names=names_out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def done() -> pa.RecordBatch:
            name, doc = (np.concatenate([h[i] for h in held]) for i in range(2))
            order = np.argsort(name, kind="stable")
            name, doc = name[order], doc[order]
            same = np.zeros(len(name), dtype=bool)
            same[1:] = name[1:] == name[:-1]
            same[:-1] |= same[1:].copy()
            full = (name[same] << np.uint64(bits)) | np.uint64(now)
            return pa.RecordBatch.from_arrays([pa.array(doc[same]), pa.array(full.view(np.int64))], names=["doc_id", "name"])

        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column("docs")))
            yield pa.RecordBatch.from_arrays([known.column("doc_id"), known.column("name")], names=["doc_id", "name"])
            rest = batch.filter(pa.compute.is_valid(batch.column("docs")))
            for bucket, docs_in, names_in in zip(rest.column("bucket").to_pylist(), rest.column("docs").to_pylist(), rest.column("names").to_pylist(), strict=True):
                if bucket != now:
                    if len(held) > 1:
                        yield done()
                    now, held = bucket, []
                n = int(np.frombuffer(docs_in, dtype=np.int64, count=1)[0])
                table, at = np.frombuffer(docs_in, dtype=np.int64, count=n, offset=8), np.frombuffer(docs_in, dtype=np.uint16 if n <= 1 << 16 else np.uint32, offset=8 + 8 * n)
                wide = np.zeros((len(at), 8), dtype=np.uint8)
                wide[:, : KEY_BITS // 8] = np.frombuffer(names_in, dtype=np.uint8).reshape(len(at), -1)
                held.append((wide.view(np.uint64).ravel(), table[at]))
        if len(held) > 1:
            yield done()

    sent = docs.select("doc_id", "text").mapInArrow(scan, "bucket bigint, doc_id bigint, name bigint, docs binary, names binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id bigint, name bigint")


def _rows(**columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values() if c is not None)
    kinds = {"docs": pa.binary(), "names": pa.binary(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.nulls(n, kinds.get(k, pa.int64())) if c is None else pa.array(c, type=kinds.get(k, pa.int64())) for k, c in columns.items()], names=list(columns))


def hot_names(names: DataFrame) -> np.ndarray:
    """Sorted names in very many documents; HOT_NAMES of them at most."""
    total = names.agg(F.sum(F.size("names"))).first()[0] or 0
    counts = names.select(F.explode("names").alias("name")).groupBy("name").count().where(F.col("count") > max(HOT, total // HOT_NAMES))
    return np.sort(np.array([r["name"] for r in counts.collect()], dtype=np.int64).view(np.uint64))


def pair_ranks(rank: np.ndarray, place: np.ndarray, min_bytes: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits that tell strings of ``min_bytes`` apart."""
    return _mix(rank[place], rank[place + min_bytes - half]), rank[place]


def later(doc: np.ndarray, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of the strings that a smaller document has too."""
    order = np.lexsort((doc, pair[1], pair[0]))
    a, b, d = pair[0][order], pair[1][order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[d > d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]]


def sent_starts(docs: DataFrame, names: DataFrame, min_bytes: int, bits: int) -> DataFrame:
    """``name, doc_id, start, count, payload``: runs with their bytes, by name; strings of hot names (count 0), by rank; what is decided (no payload)."""
    mask = np.uint64((1 << min(64, bits + KEY_BITS)) - 1)
    half = min_bytes // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            ids = part.column("doc_id").to_numpy()
            wanted = np.unique(np.array(pa.compute.list_flatten(part.column("names")), dtype=np.int64).view(np.uint64))
            data, lengths, owner, start, count, name = named_runs(texts, min_bytes)
            name = name & mask
            at = np.flatnonzero(np.isin(name, wanted))
            starts = np.cumsum(lengths) - lengths
            common = np.isin(name[at], hot.value)
            if common.any():
                run, at = at[common], at[~common]
                row = np.repeat(np.arange(len(run)), count[run])
                inside = np.arange(len(row)) - np.repeat(np.cumsum(count[run]) - count[run], count[run])
                doc, low = ids[owner[run]], start[run] - starts[owner[run]]
                pair = pair_ranks(half_ranks(data, half), start[run][row] + inside, min_bytes, half)
                gone = later(doc[row], pair)
                bitmask = np.zeros(len(run), dtype=np.int64)
                np.bitwise_or.at(bitmask, row[gone], np.int64(1) << inside[gone])
                some = bitmask != 0
                yield _rows(name=doc[some] & 0xFFFF, doc_id=doc[some], start=low[some], count=bitmask[some], payload=None)
                left = np.ones(len(row), dtype=bool)
                left[gone] = False
                x, y, doc, low = pair[0][left], pair[1][left], doc[row[left]], (low[row] + inside)[left]
                order = np.lexsort((low, doc, y, x))
                x, y, doc, low = x[order], y[order], doc[order], low[order]
                new = np.ones(len(x), dtype=bool)
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                heads = np.flatnonzero(new)
                # one row a string, with all its places in the least document
                places = [y[i : i + 1].tobytes() + low[i:j].tobytes() for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True)]
                yield _rows(name=x[heads].view(np.int64), doc_id=doc[heads], start=low[heads], count=np.zeros(len(heads), dtype=np.int64), payload=places)
            raw = data.tobytes()
            best: dict[tuple[int, bytes], tuple] = {}
            known: list[tuple[int, int, int]] = []
            for doc, low, s, c, k in zip(ids[owner[at]].tolist(), (start[at] - starts[owner[at]]).tolist(), start[at].tolist(), count[at].tolist(), name[at].view(np.int64).tolist(), strict=True):
                key = (k, raw[s : s + c + min_bytes - 1])
                row = (doc, low, c)
                was = best.get(key)
                if was is None:
                    best[key] = row
                elif was[0] < doc:
                    known.append((doc, low, (1 << c) - 1))
                elif was[0] > doc:
                    known.append((was[0], was[1], (1 << c) - 1))
                    best[key] = row
                else:  # the same document again: it is decided like its first place
                    best[(k, key[1] + low.to_bytes(8, "little"))] = row
            if known:
                doc, low, bitmask = zip(*known, strict=True)
                yield _rows(name=np.array(doc) & 0xFFFF, doc_id=doc, start=low, count=bitmask, payload=None)
            if best:
                doc, low, c = zip(*best.values(), strict=True)
                yield _rows(name=[k for k, _ in best], doc_id=doc, start=low, count=c, payload=[p[: n + min_bytes - 1] for (_, p), n in zip(best, c, strict=True)])

    hot = docs.sparkSession.sparkContext.broadcast(hot_names(names))
    return docs.select("doc_id", "text").join(names, "doc_id").mapInArrow(scan, "name bigint, doc_id bigint, start bigint, count bigint, payload binary")


def removed_starts(docs: DataFrame, names: DataFrame, min_bytes: int, bits: int) -> DataFrame:
    """``doc_id, start, mask``: bit i is set where the string at byte ``start + i`` also starts in a smaller document."""
    half = min_bytes // 2

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            single = rows.filter(pa.compute.equal(rows.column("count"), 0)).combine_chunks()
            if single.num_rows > 1:
                payload, doc = single.column("payload").to_pylist(), single.column("doc_id").to_numpy()
                gone = later(doc, (single.column("name").to_numpy().view(np.uint64), np.frombuffer(b"".join(p[:8] for p in payload), dtype=np.uint64)))
                places = [np.frombuffer(payload[i], dtype=np.int64, offset=8) for i in gone.tolist()]
                doc = np.repeat(doc[gone], [len(p) for p in places])
                low = np.concatenate([np.zeros(0, dtype=np.int64), *places])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low), pa.array(np.ones(len(low), dtype=np.int64))], names=["doc_id", "start", "mask"])
            rows = rows.filter(pa.compute.greater(rows.column("count"), 0)).combine_chunks()
            if rows.num_rows < 2:
                return
            payload = rows.column("payload").to_pylist()
            data = np.frombuffer(b"".join(payload), dtype=np.uint8)
            count = rows.column("count").to_numpy()
            doc, low = (rows.column(c).to_numpy() for c in ("doc_id", "start"))
            rank = half_ranks(data, half)
            begin = np.cumsum(count + min_bytes - 1) - (count + min_bytes - 1)
            row = np.repeat(np.arange(len(count)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            gone = later(doc[row], pair_ranks(rank, begin[row] + inside, min_bytes, half))
            bitmask = np.zeros(len(count), dtype=np.int64)
            np.bitwise_or.at(bitmask, row[gone], np.int64(1) << inside[gone])
            keep = bitmask != 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(low[keep]), pa.array(bitmask[keep])], names=["doc_id", "start", "mask"])

        rows_held = 0
        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column("payload")))
            yield pa.RecordBatch.from_arrays([known.column(c) for c in ("doc_id", "start", "count")], names=["doc_id", "start", "mask"])
            rest = batch.filter(pa.compute.is_valid(batch.column("payload")))
            held.append(rest)
            rows_held += rest.num_rows
            if rows_held >= 40_000 and rest.num_rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                names_in = whole.column("name").to_numpy()
                cut = int(np.flatnonzero(names_in != names_in[-1])[-1]) + 1 if names_in[0] != names_in[-1] else 0
                if cut:  # up to the last name, which may go on
                    yield from done(whole.slice(0, cut))
                    held = whole.slice(cut).combine_chunks().to_batches()
                    rows_held = whole.num_rows - cut
        if rows_held:
            yield from done(pa.Table.from_batches(held))

    return sent_starts(docs, names, min_bytes, bits).repartition("name").sortWithinPartitions("name").mapInArrow(meet, "doc_id bigint, start bigint, mask bigint")


def removed_bytes(n_bytes: int, starts: list, masks: list, min_bytes: int) -> np.ndarray:
    """For each byte of a text whether a removed start covers it."""
    start, mask = np.array(starts, dtype=np.int64), np.array(masks, dtype=np.int64)
    grid = (mask[:, None] >> np.arange(RUN)) & 1 == 1
    places = (start[:, None] + np.arange(RUN))[grid]
    steps = np.zeros(n_bytes + 1, dtype=np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + min_bytes, -1)
    return np.cumsum(steps)[:-1] > 0


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes).

    A byte goes if a string of ``min_bytes`` bytes that covers it also starts in a document with a smaller doc_id;
    overlaps count, and strings are judged on the input. Repeats inside one document stay. Null texts are empty.
    Rows with the same doc_id are one document for this: neither is smaller. Rows with a null doc_id have no place
    in the order and stay whole. Texts are whole, whatever their length. No rows in, no rows out.
    """
    source = docs.select("doc_id", "text")
    long = source.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_bytes))
    # a text that a smaller document has as a whole goes as a whole, and what it holds is found in that one too
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    texts = long.select("doc_id", *hashes)
    firsts = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    copies = stored(texts.join(firsts, ["h1", "h2"]).where("doc_id > first").select("doc_id", "h1", "h2").distinct())
    marked = small(copies)
    split = source.select("doc_id", "text", *hashes)
    same = split.join(marked, ["doc_id", "h1", "h2"], "left_semi").select("doc_id", "text")
    source = split.join(marked, ["doc_id", "h1", "h2"], "left_anti").select("doc_id", "text")
    known = source.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_bytes))
    bits = _bits_for(long)
    names = stored(shared_names(known, min_bytes, bits).groupBy("doc_id").agg(F.collect_set("name").alias("names")))
    touched = known.join(small(names.select("doc_id")), "doc_id", "left_semi")
    starts = removed_starts(touched, names, min_bytes, bits)
    spans = stored(starts.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks")))
    mine = small(spans.select("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = []
            for text, at, masks in zip(texts, part.column("starts").to_pylist(), part.column("masks").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < min_bytes:
                    rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                gone = removed_bytes(len(data), at, masks, min_bytes)
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = source.join(mine, "doc_id", "left_semi").join(spans, "doc_id").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    zero = F.lit(0).cast("long")
    whole = source.join(mine, "doc_id", "left_anti").select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), data.alias("kept"))
    n_bytes = F.octet_length("text").cast("long")
    gone = same.select("doc_id", n_bytes.alias("n_bytes"), n_bytes.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    return changed.unionByName(whole).unionByName(gone)
