"""Removal of repeated substrings by a sparse, hash-compared suffix sort.

A byte goes when some ``LENGTH``-byte string over it also starts earlier in the corpus. Every
such string contains the smallest hashed ``GRAM``-byte gram of its own, so only suffixes at these
anchors are sorted (about one in 35 bytes), and only where two anchors share their gram.

1. Equal surroundings of anchors (all ``LENGTH``-byte strings over the gram) are one entry of the sort: the first of them goes on, the others
   are covered. Equality is that of 128-bit BLAKE2b digests of the bytes, not of the polynomial hashes. Copies are joined in the task
   that reads them first, so that what is shuffled for a frequent gram is about one row a task.
2. Different surroundings of one gram: the suffixes right of the anchor and the reversed prefixes left of it are sorted, each by a merge sort whose
   comparisons find the common extension by binary search over prefix polynomial hashes (logarithmic in the length). Sorted neighbours are then
   checked by bytes, so a collision of hashes cannot change an order unseen. Common extensions of neighbours give, for each
   offset of a string over the gram, the classes of equal strings, of which all but the first are covered.
3. A gram with more different surroundings than a worker sorts at once (``UNIT``) is split by offsets: each half of them has a longer string that all its
   strings share, which deals the rows anew, and narrower surroundings, of which equal ones are again one entry. The parts are sorted as in 2, or
   split again; at a single offset the shared string is the whole one, so the splitting ends.

Covered spans are united per document at last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import U64, batch_rows, binary, mix, powers, prefix_hash, slices, span_hash, trimmed
from hopweave.llm._units import bounds, over_runs
from hopweave.storage import discard, materialize

LENGTH, GRAM = 100, 32
#: Different surroundings that are sorted in one piece; it bounds memory and changes no result.
UNIT = 2048
#: Anchors of texts in hand among which copies are joined before the shuffle.
JOINED = 400_000
REACH = LENGTH - GRAM  # the strings over a gram start up to this far left of it
_NEVER = U64(0xFFFFFFFFFFFFFFFF)


def _slide(a: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over a[p : p + w] for each p with a whole window."""
    n = len(a)
    b = np.concatenate([a, np.full(-n % w, pad, a.dtype)]).reshape(-1, w)
    fore = op.accumulate(b, 1).ravel()
    back = op.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return op(back[: n - w + 1], fore[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Of whole texts: anchor positions, their rows, gram hashes and the bytes known left and right."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 5
    h = prefix_hash(data)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n - GRAM + 1)
    g = span_hash(h, at, at + GRAM)
    g[at + GRAM > end[: len(at)]] = _NEVER
    least = _slide(g, REACH + 1, np.minimum, _NEVER)
    least[np.arange(len(least)) + LENGTH > end[: len(least)]] = 0
    # A gram is the smallest of some string over it if the largest of those strings' minima is itself.
    zero = np.zeros(REACH, U64)
    most = _slide(np.concatenate([zero, least, zero]), REACH + 1, np.maximum, U64(0))
    i = np.flatnonzero((most == g) & (g != _NEVER))
    row = np.searchsorted(offsets, i, "right") - 1
    left, right = np.minimum(i - offsets[row], REACH), np.minimum(offsets[row + 1] - i, LENGTH)
    return i, row, g[i], left, right


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the BLAKE2b digest of each data[start:end], left bytes of which are left of the anchor."""
    raw, blake = data.tobytes(), hashlib.blake2b
    marks = [bytes([k]) for k in range(REACH + 1)]
    out = b"".join([blake(raw[s:e], digest_size=16, salt=marks[k]).digest() for s, e, k in zip(start.tolist(), end.tolist(), left.tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _united(doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans united per document."""
    o = np.lexsort((x, doc))
    doc, x, y = doc[o], x[o], y[o]
    if not len(o):
        return doc, x, y
    b = bounds(doc)
    lift = np.repeat(np.arange(len(b) - 1), np.diff(b)) * (int(y.max()) + 1)  # one running maximum for all documents
    top = np.maximum.accumulate(y + lift) - lift
    new = np.r_[True, (x[1:] > top[:-1]) | (doc[1:] != doc[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]
    return doc[new], x[new], top[last]


ANCHORS = "h long, c1 long, c2 long, id long, at long"
ENTRIES = "kind long, h long, id long, x long, y long, left long, right long, lo long, hi long, bytes binary"
NAMES = [c.split()[0] for c in ENTRIES.split(", ")]
SPAN, SORTED, SPLIT = 0, 1, 2


def _rows(kind, h, doc, x, y=None, left=None, right=None, lo=None, hi=None, text=None) -> pa.RecordBatch:
    """ENTRIES: a covered span x..y of a row, or the place x of an entry of the sort with the bytes around it, whose strings start lo to hi bytes left of it."""
    n = len(doc)
    longs = [pa.array(np.full(n, kind, np.int64) if np.isscalar(kind) else kind), *(pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()) for v in (h, doc, x, y, left, right, lo, hi))]
    return pa.RecordBatch.from_arrays([*longs, pa.nulls(n, pa.binary()) if text is None else text], NAMES)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before; the first does."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(columns[0]) else np.zeros(0, bool)


def _emit_anchors(batches):
    """ANCHORS with the digest of their surroundings; spans of what repeats surroundings seen in the same task have at = -1 - start and c1 the end."""

    def joined(held):
        h, c1, c2, doc, at = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((at, doc, c2, c1, h))
        h, c1, c2, doc, at = (x[o] for x in (h, c1, c2, doc, at))
        first = _changes(h, c1, c2)
        pos, right = at >> 7, at & 127
        left = np.minimum(pos, REACH)
        late = ~first & (left + right >= LENGTH)
        d, x, y = _united(doc[late], (pos - left)[late], (pos + right)[late])
        parts = ((h[first], mix(d.view(U64)).view(np.int64)), (c1[first], y), (c2[first], np.zeros(len(d), np.int64)), (doc[first], d), (at[first], -1 - x))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["h", "c1", "c2", "id", "at"])

    held, size = [], 0
    for batch in batches:
        ids = batch["id"].to_numpy()
        for a, _, data, offsets in slices(batch["text"]):
            i, row, g, left, right = anchors(data, offsets)
            if len(i):
                c = digests(data, i - left, i + right, left)
                held.append((g.view(np.int64), c[:, 0], c[:, 1], ids[a + row], (i - offsets[row]) << 7 | right))
                size += len(i)
            if size > JOINED:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def _unpacked(batches):
    """ANCHORS as (ENTRIES without bytes, their digests)."""
    for batch in batches:
        h, c1, c2, doc, at = (batch[x].to_numpy() for x in ("h", "c1", "c2", "id", "at"))
        span = at < 0
        pos, right = at >> 7, at & 127
        rows = _rows(np.where(span, SPAN, SORTED), h, doc, np.where(span, -1 - at, pos), np.where(span, c1, 0), np.minimum(pos, REACH), right, np.zeros(len(h), np.int64), np.full(len(h), REACH))
        yield rows, c1, c2


def _with_digests(batches):
    for batch in batches:
        yield batch.select(NAMES), batch["c1"].to_numpy(), batch["c2"].to_numpy()


def _meet(batches):
    """Of ENTRIES sorted by gram, digest, place: spans of those with equal bytes around, but the first, and the first ones of grams with several: SORTED, or SPLIT where there are too many.

    Rows stream through; only a gram's first ones wait, until the gram ends or they are too many.
    """
    last, many = None, None  # gram and digest of the row before; the gram whose entries no longer wait
    wait: list[pa.RecordBatch] = []
    held = 0

    def flush(going):
        """Entries of whole grams, and of those known to have too many; what the going gram has waits on."""
        nonlocal wait, held, many
        t = pa.Table.from_batches(wait).combine_chunks()
        h = t["h"].to_numpy()
        size = np.repeat(np.diff(bounds(h)), np.diff(bounds(h)))
        if going is not None and (h == going).sum() > UNIT:
            many = going
        open_ = (h == going) & (h != many) if going is not None else np.zeros(len(h), bool)
        use = ~open_ & ((size > 1) | (h == many))
        out = t.set_column(0, "kind", pa.array(np.where((size > UNIT) | (h == many), SPLIT, SORTED))).filter(pa.array(use))
        wait = t.filter(pa.array(open_)).to_batches()
        held = int(open_.sum())
        return out.to_batches()

    for batch, c1, c2 in batches:
        real = batch["kind"].to_numpy() != SPAN
        if not real.all():
            yield batch.filter(pa.array(~real))
            batch, c1, c2 = batch.filter(pa.array(real)), c1[real], c2[real]
        if not batch.num_rows:
            continue
        h, doc, pos, left, right = (batch[c].to_numpy() for c in ("h", "id", "x", "left", "right"))
        first = _changes(h, c1, c2)
        first[0] = last != (h[0], c1[0], c2[0])
        last = h[-1], c1[-1], c2[-1]
        late = ~first & (left + right >= LENGTH)
        if late.any():
            d, x, y = _united(doc[late], (pos - left)[late], (pos + right)[late])
            yield _rows(SPAN, np.zeros(len(d), np.int64), d, x, y)
        wait.append(batch.filter(pa.array(first)))
        held += int(first.sum())
        if h[0] != h[-1] or held > UNIT:
            yield from flush(h[-1])
    if held:
        yield from flush(None)


def _halves(batches):
    """Each entry of a gram with too many, once for each half of its offsets: dealt by the bytes that all strings of the half share, with the bytes that any of them has."""
    for batch in batches:
        out: list[list] = [[] for _ in range(11)]
        for doc, pos, left, right, lo, hi, s in zip(*(batch[c].to_pylist() for c in ("id", "x", "left", "right", "lo", "hi", "bytes"))):
            mid = (lo + hi) // 2
            for a, b in ((lo, mid), (mid + 1, hi)):
                if left < a or right < LENGTH - b or left + right < LENGTH:
                    continue
                wl, wr = min(left, b), min(right, LENGTH - a)
                shared = hashlib.blake2b(s[left - a : left + LENGTH - b], digest_size=8, salt=bytes([a, b])).digest()
                window = s[left - wl : left + wr]
                c = hashlib.blake2b(window, digest_size=16, salt=bytes([wl])).digest()
                for x, v in zip(out, (int.from_bytes(shared, "little", signed=True), doc, pos, wl, wr, a, b, window, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True))):
                    x.append(v)
        h, doc, pos, left, right, lo, hi, c1, c2 = (np.array(x, np.int64) for x in (*out[:7], *out[8:10]))
        o = np.lexsort((pos, doc, c2, c1, h))
        late = np.zeros(len(o), bool)
        late[o] = ~_changes(h[o], c1[o], c2[o])
        d, x, y = _united(doc[late], (pos - left)[late], (pos + right)[late])
        rows = _rows(SORTED, h, doc, pos, None, left, right, lo, hi, pa.array(out[7], pa.binary())).filter(pa.array(~late))
        spans = _rows(SPAN, mix(d.view(U64)).view(np.int64), d, x, y)
        for t, a, b in ((rows, c1[~late], c2[~late]), (spans, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64))):
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(a), pa.array(b)], [*NAMES, "c1", "c2"])


def suffix_order(unit: np.ndarray, text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices sorted by (unit, text[:length]), stable; unit is ascending. A merge sort over all units at once, by hashed common extensions."""
    n, width = text.shape
    p, _ = powers(width)
    hashed = np.zeros((n, width + 1), U64)
    np.cumsum(np.where(np.arange(width) < length[:, None], text.astype(U64) + U64(1), U64(0)) * p, axis=1, out=hashed[:, 1:])
    steps = int(width).bit_length()

    def less(i, j):
        low, high = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
        for _ in range(steps):
            mid = (low + high + 1) >> 1
            same = hashed[i, mid] == hashed[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        x = np.where(low < length[i], text[i, np.minimum(low, width - 1)].astype(np.int64), -1)
        y = np.where(low < length[j], text[j, np.minimum(low, width - 1)].astype(np.int64), -1)
        return x < y

    b = bounds(unit)
    begin, size = np.repeat(b[:-1], np.diff(b)), np.repeat(np.diff(b), np.diff(b))
    order = np.arange(n)
    run = 1
    while True:
        at = np.flatnonzero(size > run)  # slots of units that are not one run yet
        if not len(at):
            break
        k = at - begin[at]
        mine = k // run
        odd = mine & 1
        low = np.minimum((mine ^ 1) * run, size[at])
        high = np.minimum(low + run, size[at])
        start = low.copy()
        e = order[at]
        for _ in range(run.bit_length()):
            open_ = low < high
            mid = (low + high) >> 1
            s = order[np.minimum(begin[at] + mid, n - 1)]
            # an element of the right run follows equal ones of the left run
            before = np.where(odd == 1, ~less(e, s), less(s, e))
            low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
        slot = begin[at] + (mine & ~1) * run + (k - mine * run) + (low - start)
        moved = order.copy()
        moved[slot] = e
        order = moved
        run *= 2
    return order


def extensions(unit: np.ndarray, order: np.ndarray, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order, checked by bytes, and the common extension of each text with the one before (-1 at the start of a unit)."""
    for again in (False, True):
        i, j = order[:-1], order[1:]
        short = np.minimum(length[i], length[j])
        differ = (text[i] != text[j]) | (np.arange(text.shape[1]) >= short[:, None])
        common = np.where(differ.any(1), differ.argmax(1), text.shape[1])
        k = np.minimum(common, text.shape[1] - 1)
        x = np.where(common < length[i], text[i, k].astype(int), -1)
        y = np.where(common < length[j], text[j, k].astype(int), -1)
        new = unit[i] != unit[j]
        if again or not (~new & (x > y)).any():
            break
        order = np.array(sorted(range(len(order)), key=lambda q: (unit[q], text[q, : length[q]].tobytes())))  # hashes collided
    return order, np.r_[-1, np.where(new, -1, common)]


def _around(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left texts (reversed) and right texts, padded, with their lengths."""
    left, right = t["left"].to_numpy(), t["right"].to_numpy()
    flat = np.frombuffer(b"".join(t["bytes"].combine_chunks().to_pylist()), np.uint8)
    middle = np.cumsum(left + right) - right
    flat = np.r_[flat, np.zeros(1, np.uint8)]
    cols = np.arange(LENGTH)
    r = flat[np.minimum(middle[:, None] + cols, len(flat) - 1)] * (cols < right[:, None])
    cols = cols[:REACH]
    a = flat[np.maximum(middle[:, None] - 1 - cols, 0)] * (cols < left[:, None])
    return a.astype(np.uint8), left, r.astype(np.uint8), right


def _compare(t: pa.Table) -> pa.RecordBatch | None:
    """Entries sorted by gram and place: covered spans."""
    unit, doc, pos, lo, hi = (t[x].to_numpy() for x in ("h", "id", "x", "lo", "hi"))
    n = len(unit)
    a, la, r, lr = _around(t)
    oa, ea = extensions(unit, suffix_order(unit, a, la), a, la)
    orr, er = extensions(unit, suffix_order(unit, r, lr), r, lr)
    ca, cr = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hit = np.zeros((n, REACH + 3), bool)
    for d in range(REACH + 1):
        ok = np.flatnonzero((la >= d) & (lr >= LENGTH - d) & (lo <= d) & (d <= hi))
        if len(ok) < 2:
            continue
        ca[oa] = np.cumsum(ea < d)
        cr[orr] = np.cumsum(er < LENGTH - d)
        key = ca[ok] * (n + 1) + cr[ok]
        _, first = np.unique(key, return_index=True)
        late = np.ones(len(ok), bool)
        late[first] = False
        hit[ok[late], d + 1] = True
    # each run of offsets is one span
    i, d0 = np.nonzero(hit[:, 1:] & ~hit[:, :-1])
    _, d1 = np.nonzero(hit[:, :-1] & ~hit[:, 1:])
    if not len(i):
        return None
    return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(pos[i] - (d1 - 1)), pa.array(pos[i] - d0 + LENGTH)], ["id", "x", "y"])


def _surroundings(batches):
    """The bytes around the places of each document, as ENTRIES."""
    for batch in batches:
        text, places = binary(batch["text"]), batch["places"]
        docs = batch["id"].to_numpy()
        for k in range(batch.num_rows):
            s = text[k].as_buffer().to_pybytes()
            own = places[k].values
            for a in range(0, len(own), 20_000):
                kind, pos, h = (own.field(c).to_numpy()[a : a + 20_000] for c in range(3))
                left, right = np.minimum(pos, REACH), np.minimum(len(s) - pos, LENGTH)
                around = pa.array([s[x:y] for x, y in zip((pos - left).tolist(), (pos + right).tolist())], pa.binary())
                yield _rows(kind, h, np.full(len(pos), docs[k]), pos, None, left, right, np.zeros(len(pos), np.int64), np.full(len(pos), REACH), around)


def _numbered(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text, extra) with ids that are unique and in the order of doc_id (null first), then text; extra holds the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), extra.alias("extra"))
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.select(F.col("doc_id").alias("id"), "doc_id", "text", "extra")
    return materialize(docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", "extra"), "sub-docs")


def _met(rows: DataFrame, place: str, read) -> DataFrame:
    """rows dealt by gram and run through _meet, stored."""
    order = ["h", "c1", "c2", "id", place]
    return materialize(rows.repartition("h").sortWithinPartitions(*order).mapInArrow(trimmed(lambda batches: _meet(read(batches))), ENTRIES), "sub-met")


def covered_spans(docs: DataFrame) -> DataFrame:
    """(id, x, y) spans, overlapping as they come, whose union per row of docs(id, text) is what repeats something earlier."""
    own = docs.select("id", "text")
    met = _met(own.mapInArrow(trimmed(_emit_anchors), ANCHORS), "at", _unpacked)
    places = met.where(F.col("kind") != SPAN).groupBy("id").agg(F.collect_list(F.struct("kind", "x", "h")).alias("places"))
    rows = own.join(places, "id").mapInArrow(trimmed(_surroundings), ENTRIES)
    split = not met.where(F.col("kind") == SPLIT).isEmpty()
    if split:
        rows = materialize(rows, "sub-around")
    spans, order = [met], ["id", "x"]
    compared = [over_runs(rows.where(F.col("kind") == SORTED), ["h"], _compare, "id long, x long, y long", order)]
    while split:
        rows = _met(rows.where(F.col("kind") == SPLIT).mapInArrow(trimmed(_halves), f"{ENTRIES}, c1 long, c2 long"), "x", _with_digests)
        spans.append(rows)
        compared.append(over_runs(rows.where(F.col("kind") == SORTED), ["h"], _compare, "id long, x long, y long", order))
        split = not rows.where(F.col("kind") == SPLIT).isEmpty()
    out = compared[0]
    for t in compared[1:]:
        out = out.union(t)
    for t in spans:
        out = out.union(t.where(F.col("kind") == SPAN).select("id", "x", "y"))
    return out


def remove_repeats(docs: DataFrame, spans: DataFrame, as_text: bool = False) -> DataFrame:
    """docs(id, doc_id, text, extra) with text replaced by kept (binary), n_bytes, n_removed and n_spans, after the spans of each id are united.

    With as_text kept is a string, without what is left of characters that were cut in two.
    """

    def run(batches):
        for batch in batches:
            text = binary(batch["text"])
            kept, total, gone, count = [], [], [], []
            for s, own in zip(text, batch["spans"]):
                s = s.as_buffer().to_pybytes()
                cut = []
                if own.is_valid and len(own):
                    v = own.values
                    x, y = v.field(0).to_numpy(), v.field(1).to_numpy()
                    o = np.argsort(x, kind="stable")
                    x, top = x[o], np.maximum.accumulate(y[o])
                    new = np.r_[True, x[1:] > top[:-1]]
                    cut = list(zip(x[new].tolist(), top[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]].tolist()))
                at, parts = 0, []
                for x, y in cut:
                    parts.append(s[at:x])
                    at = y
                parts.append(s[at:])
                left = b"".join(parts)
                for c, v in zip((kept, total, gone, count), (left, len(s), len(s) - len(left), len(cut))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["extra"], pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (total, gone, count))], ["doc_id", "extra", "kept", "n_bytes", "n_removed", "n_spans"])

    lists = spans.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("spans"))
    kind = docs.schema["extra"].dataType.simpleString()
    return docs.join(lists, "id", "left").select("doc_id", "extra", "text", "spans").mapInArrow(trimmed(run), f"doc_id long, extra {kind}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")


def dedup_substrings(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """(doc_id, extra, kept, n_bytes, n_removed, n_spans) of every row of docs(doc_id, text).

    Texts are UTF-8 bytes, null is empty. Each byte goes that is covered by a LENGTH-byte string which also starts earlier: in a smaller doc_id, or
    earlier in the same document. Strings never cross documents and are judged on the input. kept holds the remaining bytes (with as_text a string of the
    whole characters left), n_spans
    counts the maximal removed runs. Rows with a null doc_id come first, rows that repeat a doc_id are documents of their own in the order of their
    texts. Other columns come back in the struct extra; an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, 2000)
    docs = _numbered(docs)
    return remove_repeats(docs, covered_spans(docs), as_text)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
