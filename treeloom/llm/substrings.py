"""Removal of repeated substrings with a sparse, distributed suffix array.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller
id. Every LENGTH-byte window is represented by its least k-gram (least by hash, leftmost):
windows are equal only if they are represented by equal k-grams at equal offsets, so only
suffixes that start at representatives, about one byte in sixteen, need sorting.

1. Suffixes, with fingerprints of all windows each represents, are range-partitioned by sampled
   splitters on their leading bytes and sorted in their bucket (leading bytes, k-gram, run of
   windows, document). Equal runs are neighbours: all but the smallest document's are removed
   whole. Runs are told apart by eight raw bytes, 32 bits for the k-gram and 96 for the run.
2. Runs that differ from a neighbour with the same k-gram, and those at either end of a bucket,
   may still share single windows. Their stretches of text are range-partitioned by k-gram and
   bytes, so a frequent k-gram is dealt to many buckets. In a bucket the windows of each k-gram
   are sorted by multikey quicksort on their bytes, eight at a time, and neighbours compared.
3. A k-gram at either end of a bucket, or with more windows than a task sorts at once, may go on
   elsewhere: what is left of its windows is range-partitioned by the windows' own bytes and
   compared again, across those boundaries.

Before each shuffle a batch resolves what repeats inside it: only the smallest document of a
string stays as a source, so a string in a third of all documents sends a row per batch.
Steps 2 and 3 compare bytes; step 1 compares the fingerprints named there.

Null text is empty. Rows with a null id keep everything and remove nothing. Rows that repeat an
id and text get the same result each; ids must otherwise be unique. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import tokens
from treeloom.llm.scratch import Scratch, bounded_batches

LENGTH = 50
#: Bytes of a representative; a window of LENGTH bytes has LENGTH - GRAM + 1 of them.
GRAM = 20
#: Windows handled at a time.
SLICE = 1 << 18
#: Windows sorted at a time, about; rows of one group of suffixes, and stretches of one k-gram, held at a time.
PART, HELD, STRETCHES = 150_000, 200_000, 12_000
ROWS = "lead long, h long, run long, doc long, at long"
OPEN = "lead long, h long, doc long, at long, cut binary"
SPANS = "doc long, at long, cut binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_rng = np.random.default_rng(9)
#: Two independent families: a random number for each byte value, and a base.
_FAMILIES = [(_rng.integers(0, 1 << 64, 256, np.uint64), int(_rng.integers(0, 1 << 61)) * 8 + 5) for _ in range(2)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(step)
        step = step * step % (1 << 64)
        done += k
    return out


class Hashes:
    """Hashes of any substring of a buffer, from prefix sums modulo 2**64."""

    cached: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(0, np.uint64), np.ones(0, np.uint64))] * 2

    def __init__(self, raw: np.ndarray, family: int = 0):
        n, (table, base) = len(raw), _FAMILIES[family]
        if len(Hashes.cached[family][0]) < n + 1:
            Hashes.cached[family] = _powers(base, n + 1), _powers(pow(base, -1, 1 << 64), n + 1)
        powers, self.inverse = Hashes.cached[family]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw] * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def grams(self, length: int) -> np.ndarray:
        h = (self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h


def _leads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a signed number of the same order."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | raw[at + k].astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def _window_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours (van Herk: two running minima over blocks)."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _slices(raw: np.ndarray, bounds: np.ndarray, length: int):
    """(offset, bytes, valid windows) of pieces of a buffer of documents, in order."""
    starts_at = np.zeros(max(0, len(raw) - length + 1), bool)
    marks = np.zeros(len(starts_at) + 1, np.int32)
    ok = bounds[1:] - bounds[:-1] >= length
    np.add.at(marks, bounds[:-1][ok], 1)
    np.add.at(marks, bounds[1:][ok] - length + 1, -1)
    starts_at = np.cumsum(marks[:-1]) > 0
    for s in range(0, len(starts_at), SLICE):
        valid = starts_at[s : s + SLICE]
        if valid.any():
            yield s, raw[s : s + len(valid) + length - 1], valid


def runs(raw: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """Runs of windows with one representative: (first window, windows, lead, h, run).

    The upper half of h is a hash of the k-gram; its lower half and run are hashes of the run.
    """
    h = Hashes(raw)
    grams = h.grams(gram)
    keys = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    least = (_window_argmin(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    least[~valid] = -1
    cut = np.flatnonzero(np.diff(least)) + 1
    first = np.append(0, cut)
    last = np.append(cut, len(least))
    keep = least[first] >= 0
    first, last = first[keep], last[keep]
    anchor = least[first]
    whole = h(first, last + length - 1) ^ (last - first).astype(np.uint64)
    both = (h(anchor, anchor + gram) >> np.uint64(32) << np.uint64(32)) | (Hashes(raw, 1)(first, last + length - 1) >> np.uint64(32))
    return first, last - first, _leads(raw, anchor), both.view(np.int64), whole.view(np.int64)


def _combine(lead: np.ndarray, h: np.ndarray, run: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Resolve repeats inside a batch: larger documents' rows become spans (lowest bit of at set).

    Spans need no comparison, so they are dealt by a hash of their own.
    """
    order = np.lexsort((doc, run, h, lead))
    lead, h, run, doc, at = lead[order], h[order], run[order], doc[order], at[order]
    new = np.append(True, (lead[1:] != lead[:-1]) | (h[1:] != h[:-1]) | (run[1:] != run[:-1]))
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(doc) else doc
    done = doc > least
    mixed = ((doc[done].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[done].astype(np.uint64)) * _MIX).view(np.int64)
    lead[done], h[done], run[done] = mixed, mixed, mixed
    at[done] |= 1
    return lead, h, run, doc, at


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    parts = [t or b"" for t in tokens.raw_bytes(texts)]
    bounds = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), bounds


def _batch(lead, h, run, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in (lead, h, run, doc, at)], names=["lead", "h", "run", "doc", "at"])


def _suffixes(length: int, gram: int):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            raw, bounds = _buffer(b.column(1))
            found = []
            for s, part, valid in _slices(raw, bounds, length):
                first, n, lead, h, whole = runs(part, valid, length, gram)
                row = np.searchsorted(bounds, first + s, "right") - 1
                found.append((lead, h, whole, ids[row], ((first + s - bounds[row]) << 8) | (n << 1)))
            if found:
                yield _batch(*_combine(*map(np.concatenate, zip(*found, strict=True))))

    return run


def _segments(doc: np.ndarray, run: np.ndarray, p: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of stretches of one document, run and verdict."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (run[1:] != run[:-1]) | (p[1:] != p[:-1] + 1) | (gone[1:] != gone[:-1]))
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(doc)))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as a number of the same order."""
    if len(raw) < 8:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(">u8").ravel().astype(np.uint64)


def multikey_quicksort(eights: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the length-byte strings that start at p, and where strings differ from the one before.

    Breadth first: all strings are sorted by their first eight bytes, then those still tied, each
    group in itself, by the next eight, until no ties or bytes are left.
    """
    order = np.argsort(eights[p], kind="stable")
    w = eights[p[order]]
    new = np.append(True, w[1:] != w[:-1])[: len(p)]
    for step in [*range(8, length - 8, 8), length - 8]:
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(p)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        rows = order[tied]
        w = eights[p[rows] + step]
        turn = np.lexsort((w, np.cumsum(new)[tied]))
        order[tied], w = rows[turn], w[turn]
        new[tied[1:]] |= w[1:] != w[:-1]
    return order, new


def _larger(eights: np.ndarray, p: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which windows also start in a smaller document of those given."""
    out = np.zeros(len(p), bool)
    if len(p):
        order, new = multikey_quicksort(eights, p, length)
        start, sorted_ = np.flatnonzero(new), doc[order]
        out[order] = sorted_ > np.repeat(np.minimum.reduceat(sorted_, start), np.diff(np.append(start, len(p))))
    return out


def _contexts(length: int, gram: int):
    """(doc, packed text, runs) to stretches of those runs that the batch leaves open, with their bytes."""
    width = length - gram + 1

    def flush(texts: list[tuple[int, np.ndarray, np.ndarray]]):
        docs, raws, ats = zip(*texts, strict=True)
        base = np.cumsum([0, *map(len, raws)])[:-1]
        raw = np.concatenate(raws)
        first = np.concatenate([b + (at >> 8) for b, at in zip(base, ats, strict=True)])
        n = np.concatenate([at >> 1 & 127 for at in ats])
        ids = np.repeat(np.array(docs, np.int64), [len(at) for at in ats])
        start_of = np.repeat(base, [len(at) for at in ats])
        h = Hashes(raw)
        run = np.repeat(np.arange(len(n)), n)
        p = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = ids[run]
        gone = _larger(_eights(raw), p, doc, length)
        seg, count = _segments(doc, run, p, gone)
        at = ((p[seg] - start_of[run[seg]]) << 8) | (count << 1) | gone[seg]
        done = gone[seg]
        # Every window of a run has the same representative; a few thousand rows of k-grams at a time.
        anchor = p[seg]
        for k in range(0, len(seg), 4096):
            anchor[k : k + 4096] += _order(anchor[k : k + 4096], h, width, gram)
        lead, key = _leads(raw, anchor), h(anchor, anchor + gram).view(np.int64)
        mixed = ((doc[seg].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)) * _MIX).view(np.int64)
        lead[done], key[done] = mixed[done], mixed[done]
        whole = raw.tobytes()
        cut = [b"" if g else whole[x : x + c + length - 1] for g, x, c in zip(done.tolist(), p[seg].tolist(), count.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(lead), pa.array(key), pa.array(doc[seg]), pa.array(at), pa.array(cut, pa.binary())], names=["lead", "h", "doc", "at", "cut"])

    def run_all(batches):
        unpack = zstandard.ZstdDecompressor()
        texts, size = [], 0
        for b in batches:
            for doc, packed, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = np.frombuffer(unpack.decompress(packed), np.uint8)
                at = np.unique(at.values.to_numpy())
                at = at[(at >> 8) + (at >> 1 & 127) + length - 1 <= len(raw)]
                for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(at >> 1 & 127) // PART)) + 1):
                    texts.append((doc, raw, part))
                    size += len(raw) + 8 * int((part >> 1 & 127).sum())
                    if size > SLICE * 4:
                        yield flush(texts)
                        texts, size = [], 0
        if texts:
            yield flush(texts)

    return run_all


def _order(p: np.ndarray, h: Hashes, width: int, gram: int) -> np.ndarray:
    """Offset of the representative of each window: its least k-gram by hash, leftmost."""
    at = p[:, None] + np.arange(width)
    keys = (h.sums[at + gram] - h.sums[at]) * h.inverse[at]
    keys ^= keys >> np.uint64(32)
    keys *= _MIX
    return (keys >> np.uint64(32)).argmin(1)


def _compare_contexts(length: int, stretches: int):
    """Sorted stretches of a bucket to spans, and to the windows that a boundary leaves open."""

    def settle(table: pa.Table, edge: np.ndarray):
        """Spans of a few keys' stretches; of those at an edge also the windows that stay."""
        doc, at = table["doc"].to_numpy(), table["at"].to_numpy()
        done = (at & 1).astype(bool)
        yield from _spans(doc[done], at[done])
        if done.all():
            return
        kept, edge = table.filter(pa.array(~done)), edge[~done]
        doc, at, cut = kept["doc"].to_numpy(), kept["at"].to_numpy(), kept["cut"].to_pylist()
        whole = b"".join(cut)
        raw, begins = np.frombuffer(whole, np.uint8), np.cumsum([0, *map(len, cut)])[:-1]
        n = at >> 1 & 127
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = begins[row] + within
        gone = _larger(_eights(raw), p, doc[row], length)
        seg, count = _segments(row, row, within, gone)
        seg, count = seg[gone[seg]], count[gone[seg]]
        yield from _spans(doc[row[seg]], (((at[row[seg]] >> 8) + within[seg]) << 8) | (count << 1) | 1)
        left = np.flatnonzero(edge[row] & ~gone)
        for k in range(0, len(left), 20_000):
            some = left[k : k + 20_000]
            yield from _spans(doc[row[some]], (((at[row[some]] >> 8) + within[some]) << 8) | 2, [whole[x : x + length] for x in p[some].tolist()])

    def portions(table: pa.Table, edge: np.ndarray):
        """The table in parts of about PART windows, each with whole keys or part of one key, which is then an edge."""
        lead, h = table["lead"].to_numpy(), table["h"].to_numpy()
        n = np.cumsum(table["at"].to_numpy() >> 1 & 127)
        starts = np.flatnonzero(np.append(True, (lead[1:] != lead[:-1]) | (h[1:] != h[:-1])))
        ends = np.append(starts[1:], len(lead))
        a = 0
        while a < len(lead):
            limit = int(np.searchsorted(n, (n[a - 1] if a else 0) + PART, "right"))
            b = int(ends[max(0, np.searchsorted(ends, limit, "right") - 1)])
            if b <= a:  # a key that is too large for one part
                b = max(a + 1, limit)
                k = int(np.searchsorted(starts, a, "right")) - 1
                edge[starts[k] : ends[k]] = True
            yield table.slice(a, b - a), edge[a:b]
            a = b

    def run(batches):
        held: list[pa.RecordBatch] = []
        open_keys: list[tuple[int, int]] = []  # the bucket's first key, and one that was sorted in parts

        def flush(rows: list[pa.RecordBatch], last: bool):
            table = pa.Table.from_batches(rows)
            lead, h = table["lead"].to_numpy(), table["h"].to_numpy()
            if not open_keys:
                open_keys.append((int(lead[0]), int(h[0])))
            if last:
                open_keys.append((int(lead[-1]), int(h[-1])))
            edge = np.zeros(len(lead), bool)
            for a, b in open_keys:
                edge |= (lead == a) & (h == b)
            open_keys[1:] = open_keys[-1:]
            for part, at_edge in portions(table, edge):
                yield from settle(part, at_edge)

        for b in batches:
            if not len(b):
                continue
            lead, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(lead[0]), int(h[0])):
                yield from flush(held, False)
                held = []
            differs = np.flatnonzero((lead != lead[-1]) | (h != h[-1]))
            last = int(differs[-1]) + 1 if len(differs) else 0
            if last:
                yield from flush([*held, b.slice(0, last)], False)
                held = []
            held.append(b.slice(last))
            if sum(map(len, held)) > stretches:  # a key with many stretches: those so far stand for themselves
                yield from flush(held, True)
                held = []
        if held:
            yield from flush(held, True)

    return run


def _spans(doc: np.ndarray, at: np.ndarray, cut: list[bytes] | None = None):
    if len(doc):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(cut or [None] * len(doc), pa.binary())], names=["doc", "at", "cut"])


def _first_wins(batches):
    """Windows sorted by bytes, then document, to spans of all but the smallest document's."""
    window, least = None, None
    for b in batches:
        docs, ats = [], []
        for doc, at, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cut != window:
                window, least = cut, doc
            if doc > least:
                docs.append(doc)
                ats.append(at | 1)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int64())], names=["doc", "at"])


def _neighbours(batches):
    """Sorted rows of a bucket to spans (lowest bit of at set) and runs to look into.

    A run is looked into if the run before or after it in the bucket has the same k-gram, or
    lies beyond the bucket's end, where it cannot be seen.
    """

    def settle(rows: list[np.ndarray], new: np.ndarray, count: int, last: bool, before: tuple | None):
        """The rows of the first count groups; new holds where groups start."""
        end = new[count] if count < len(new) else len(rows[0])
        doc, at = rows[3][:end], rows[4][:end]
        starts = new[:count]
        group = np.repeat(np.arange(count), np.diff(np.append(starts, end)))
        gone = (at & 1).astype(bool) | (doc > doc[starts][group])
        yield from _pairs(doc[gone], at[gone] | 1)
        every = new[: count + 1]
        gl, gh = rows[0][every], rows[1][every]
        same = (gl[1:] == gl[:-1]) & (gh[1:] >> 32 == gh[:-1] >> 32)
        unsure = np.zeros(len(every), bool)
        unsure[1:] |= same
        unsure[:-1] |= same
        unsure[0] |= before is None or before == (int(gl[0]), int(gh[0]) >> 32)
        unsure[-1] |= last
        more = unsure[group] & ~gone
        yield from _pairs(doc[more], at[more])

    held, before = None, None
    for b in batches:
        rows = [c.to_numpy() for c in b.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        lead, h, run = rows[:3]
        new = np.flatnonzero(np.append(True, (lead[1:] != lead[:-1]) | (h[1:] != h[:-1]) | (run[1:] != run[:-1])))
        held = rows
        if len(lead) and len(new) > 1:  # the last group waits, as more of its rows may follow
            yield from settle(rows, new, len(new) - 1, False, before)
            before = int(lead[new[-2]]), int(h[new[-2]]) >> 32
            held = [x[new[-1] :] for x in rows]
        if len(held[0]) > HELD:  # rows of one group: looked into, but for the first, which later ones are compared with
            yield from settle(held, np.zeros(1, np.int64), 1, True, before)
            held = [x[:1] for x in held]
    if held is not None and len(held[0]):
        yield from settle(held, np.zeros(1, np.int64), 1, True, before)


def _pairs(doc: np.ndarray, at: np.ndarray):
    if len(doc):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], names=["doc", "at"])


def _sorted_pairs(rows: DataFrame) -> DataFrame:
    """Range-partition by sampled splitters, sort each bucket by several keys, compare neighbours."""
    return rows.repartitionByRange("lead", "h", "run").sortWithinPartitions("lead", "h", "run", "doc").mapInArrow(_neighbours, "doc long, at long")


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack.compress(t or b"") for t in tokens.raw_bytes(b.column(1))], pa.binary())], names=["doc_id", "packed"])


def _cut(length: int):
    """(doc_id, packed text, spans) to what is left of each text."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, packed, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = np.frombuffer(unpack.decompress(packed), np.uint8)
                removed, spans = 0, []
                if at.is_valid:
                    at = np.unique(at.values.to_numpy())
                    start, end = at >> 8, np.minimum((at >> 8) + (at >> 1 & 127) + length - 1, len(raw))
                    reach = np.maximum.accumulate(end)
                    head = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                    spans = list(zip(start[head].tolist(), reach[np.append(head[1:] - 1, len(reach) - 1)].tolist(), strict=True))
                    removed = sum(e - s for s, e in spans)
                kept, last = hashlib.sha256(), 0
                text = raw.tobytes()
                for s, e in spans:
                    kept.update(text[last:s])
                    last = e
                kept.update(text[last:])
                rows.append((doc, len(text), removed, len(spans), kept.hexdigest(), spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                + [pa.array([[{"start": s, "end": e} for s, e in r[5]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, stretches: int = STRETCHES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes).

    stretches bounds what a task holds of one k-gram; the result is the same for any number.
    """
    if not (8 <= gram <= length and length - gram < 64):
        raise ValueError("a representative takes 8 to length bytes, and a run at most 63 windows")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    bounded_batches(spark, rows=20_000, megabytes=1)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    known = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    marks = scratch.save(_sorted_pairs(known.mapInArrow(_suffixes(length, gram), ROWS)), "marks")

    unsure = marks.where("at & 1 = 0").groupBy("doc").agg(F.collect_list("at").alias("at"))
    looked = known.mapInArrow(_packed, "doc_id long, packed binary").join(unsure.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id")
    open_ = scratch.save(looked.select("doc_id", "packed", "at").mapInArrow(_contexts(length, gram), OPEN), "open")
    dealt = open_.repartitionByRange("lead", "h", "cut").sortWithinPartitions("lead", "h", "cut")
    single = scratch.save(dealt.mapInArrow(_compare_contexts(length, stretches), SPANS), "windows")
    scratch.drop(open_)
    edges = single.where("cut is not null").repartitionByRange("cut").sortWithinPartitions("cut", "doc")
    across = scratch.save(edges.mapInArrow(_first_wins, "doc long, at long"), "across")

    found = marks.where("at & 1 = 1").union(single.where("cut is null").select("doc", "at")).union(across)
    spans = found.groupBy("doc").agg(F.collect_list("at").alias("at")).withColumnRenamed("doc", "doc_id")
    every = docs.mapInArrow(_packed, "doc_id long, packed binary").join(spans.hint("shuffle_hash"), "doc_id", "left")
    return every.select("doc_id", "packed", "at").mapInArrow(_cut(length), RESULT + ", spans array<struct<start:long,end:long>>")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
