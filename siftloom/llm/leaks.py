"""Problem 8: evaluation texts leaking into training text.

Windows of letters and digits start at winnowed anchors (the least k-gram hash of every run of
ANCHOR_RUN k-grams), so a passage shared by a document and an item shares an anchor, wherever it
stands. Each window, of a size that fits the item, goes through the CGK random walk: one symbol is
put out at every step and the place moves on or stays by a random bit of that symbol and step,
which turns edit distance into Hamming distance. Repetitions of BITS sampled steps each are the keys
of a locality-sensitive hash; their number follows from the target recall (RECALL) and from how
often sampled steps agree at the allowed share of edits, which is simulated once for every window
size. Unchanged passages agree in every step, so without edits one repetition finds all of them.

Every colliding (document, item) pair is verified exactly: the least number of edits at which some
passage of the item, of the shortest length that counts, stands in the document. Extensions of all
common k-grams to both sides along the furthest-reaching diagonals find it, since a passage with so
few edits has an unchanged run of GRAM letters.

Items too short for windows have all their shortest passages as keys, without edits. A bitmap of
the known keys keeps all other windows of the documents from going any further. The index of the
items is sent to the executors below INDEX_BYTES and joined by key as a table above; both ways use
the same keys and the same verification. Documents never leave their task except as found pairs or,
in the join, as candidates. Null and empty texts and items without letters hold nothing. Repeated
documents and items are each reported.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.textbatch import TextBatch, chunks, mix64, prefix_hash, span_hash, window_starts
from siftloom.session import cut

#: Share of an item's letters and digits that an unbroken passage must hold; share of a passage's letters that may be edited.
MIN_SHARE, EDITS = 0.4, 0.1
#: Letters of an anchor's k-gram; k-grams in a run of which one is chosen, a power of two.
GRAM, ANCHOR_RUN = 5, 8
#: Window sizes; an item uses the largest that its shortest passage holds behind any anchor, 0 if that passage may hold none (with edits:
#: that fits the passage twice). Windows longer than GATE are walked only where the walk over their first GATE letters meets an
#: item, unless edits are allowed.
SIZES, GATE = (4, 8, 16, 24, 48, 96), 24
#: Sampled steps of a repetition, steps of the walk as a multiple of the window, share of edited passages that must be met, most repetitions.
BITS, STRETCH, RECALL, MOST_BANDS = 12, 2, 0.95, 24
#: Bits of the table that tells whether a key may be known.
GATE_BITS = 22
GATE_MASK = np.uint64((1 << GATE_BITS) - 1)
#: Largest index that is broadcast.
INDEX_BYTES = 64 << 20


def shortest_passage(letters: int, share: float = MIN_SHARE) -> int:
    return max(1, math.ceil(share * letters - 1e-9))


def most_edits(letters: int, share: float = MIN_SHARE, edits: float = 0.0) -> int:
    """Edits allowed in the shortest passage: so few that an unchanged run of GRAM letters remains."""
    need = shortest_passage(letters, share)
    return max(0, min(int(edits * need + 1e-9), (need - GRAM) // (GRAM + 1)))


def size_for(letters: int, share: float = MIN_SHARE, edits: float = 0.0) -> int:
    passage = shortest_passage(letters, share)
    if passage < ANCHOR_RUN + GRAM - 1:  # no whole run of k-grams, so it may hold no anchor
        return 0
    room = passage // 2 if most_edits(letters, share, edits) else passage - (ANCHOR_RUN - 1)
    return max([s for s in SIZES if s <= max(room, SIZES[0])], default=0)


def anchors(let: TextBatch, prefix: np.ndarray) -> np.ndarray:
    """Places of the winnowed anchors; in texts with fewer k-grams than a run, every k-gram is one."""
    st = window_starts(let, GRAM)
    if not len(st):
        return st
    h = span_hash(prefix, st, st + GRAM)
    own = let.owner()[st]
    chosen = np.bincount(own, minlength=len(let))[own] < ANCHOR_RUN
    whole = len(h) - ANCHOR_RUN + 1
    if whole > 0:
        least, span = h, 1
        while span < ANCHOR_RUN:  # least hash of each run, by doubling
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.where(own[:whole] == own[ANCHOR_RUN - 1 :], least, np.uint64(0))
        # a place is chosen if it is the least of some run: if the largest of its runs' minima is its own hash
        most, span = np.concatenate([np.zeros(ANCHOR_RUN - 1, np.uint64), least, np.zeros(ANCHOR_RUN - 1, np.uint64)]), 1
        while span < ANCHOR_RUN:
            most = np.maximum(most[:-span], most[span:])
            span *= 2
        chosen |= most == h
    return st[chosen]


@functools.cache
def sampled_steps(size: int, bands: int) -> list[np.ndarray]:
    rng = np.random.default_rng(size)
    return [np.sort(rng.choice(size * STRETCH, min(BITS, size * STRETCH), replace=False)) for _ in range(bands)]


@functools.cache
def moves(size: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 31, size * STRETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def walk_keys(let: TextBatch, place: np.ndarray, size: int, bands: int = 1, block: int = 1 << 16) -> list[np.ndarray]:
    """One key for each repetition and window that starts at place and has size letters; block: windows walked at once."""
    wanted = sampled_steps(size, bands)
    last = max(int(w[-1]) for w in wanted)
    taken: dict[int, list[int]] = {}
    for b, steps in enumerate(wanted):
        for step in steps.tolist():
            taken.setdefault(step, []).append(b)
    go = moves(size)
    cps = np.concatenate([let.cps.astype(np.uint32), np.zeros(size * STRETCH + 1, np.uint32)])
    out = [np.empty(len(place), np.uint64) for _ in range(bands)]
    for lo in range(0, len(place), block):
        start = place[lo : lo + block]
        at = start.copy()
        keys = [np.full(len(start), b + 1, np.uint64) for b in range(bands)]
        with np.errstate(over="ignore"):
            for step in range(last + 1):
                c = cps[at]
                if step in taken:
                    seen = np.where(at - start < size, c, np.uint32(0))
                    for b in taken[step]:
                        keys[b] = (keys[b] + seen) * np.uint64(0x9E3779B97F4A7C15)
                        keys[b] ^= keys[b] >> np.uint64(29)
                at += (c * go[step]) >> np.uint32(31)
        for b in range(bands):
            out[b][lo : lo + block] = mix64(keys[b], size)
    return out


@functools.cache
def agreement(size: int, edits: float, trials: int = 400) -> float:
    """How likely all sampled steps of a repetition agree for a window edited at that rate, by seeded simulation."""
    rng = np.random.default_rng((size, trials))
    plain = rng.integers(97, 123, (trials, 2 * size), dtype=np.uint32)
    other = np.zeros_like(plain)
    for i, row in enumerate(plain):
        out: list[int] = []
        for c, u, v in zip(row.tolist(), rng.random(2 * size), rng.integers(97, 123, 2 * size), strict=True):
            kind = u / edits * 3 if u < edits else 9.0
            out += [int(v)] if kind < 1 else [] if kind < 2 else [c, int(v)] if kind < 3 else [c]
        other[i, : len(out)] = out[: 2 * size]
    both = []
    for rows in (plain, other):
        let = TextBatch(rows.ravel(), np.arange(trials + 1, dtype=np.int64) * 2 * size)
        both.append(walk_keys(let, let.off[:-1], size, 8))
    return float(np.mean([x == y for x, y in zip(*both, strict=True)]))


def bands_for(size: int, edits: float, recall: float = RECALL) -> int:
    """Repetitions that reach the recall at the allowed edits; a passage holds more than one window whose anchor is unchanged."""
    p = 1.0 if not edits else agreement(size, edits)
    return 1 if p >= 1 else min(MOST_BANDS, math.ceil(math.log(1 - recall) / (1.4 * math.log(1 - max(p, 1e-6)))))


@dataclasses.dataclass
class Plan:
    """What the keys of documents are made for: window sizes and short passages that any item has, and which keys are known."""

    sizes: list[int]
    lengths: list[int]
    share: float = MIN_SHARE
    edits: float = 0.0
    known: np.ndarray | None = None
    first: np.ndarray | None = None

    @classmethod
    def of(cls, counts: np.ndarray, share: float, edits: float) -> "Plan":
        """From the numbers of letters of all items."""
        some = [int(n) for n in counts if n > 0]
        sizes = {n: size_for(n, share, edits) for n in some}
        return cls(sorted({s for s in sizes.values() if s}), sorted({shortest_passage(n, share) for n, s in sizes.items() if not s}), share, edits)

    def item_keys(self, let: TextBatch, gate: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(item, key) of all windows and short passages of items; gate: the keys of the first GATE letters of longer windows instead."""
        count = np.diff(let.off)
        sizes = np.array([size_for(int(n), self.share, self.edits) if n else -1 for n in count], np.int64)
        own_of, prefix = let.owner(), prefix_hash(let.cps)
        place = anchors(let, prefix)
        own = own_of[place]
        who, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in self.sizes:
            if gate and size <= GATE:
                continue
            ok = (sizes[own] == size) & (place + size <= let.off[own + 1])
            walked = GATE if gate else size
            for k in walk_keys(let, place[ok], walked, self.bands(walked)):
                who.append(own[ok])
                keys.append(k)
        need = np.array([shortest_passage(int(n), self.share) if n else 0 for n in count], np.int64)
        for length in [] if gate else self.lengths:
            st = window_starts(let, length)
            st = st[(need[own_of[st]] == length) & (sizes[own_of[st]] == 0)]
            who.append(own_of[st])
            keys.append(span_hash(prefix, st, st + length))
        return np.concatenate(who), np.concatenate(keys)

    def bands(self, size: int) -> int:
        return bands_for(size, self.edits)

    def knows(self, keys: np.ndarray) -> np.ndarray:
        return np.ones(len(keys), bool) if self.known is None else self.known[(keys & GATE_MASK).astype(np.int64)]

    def document_keys(self, let: TextBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, key) arrays of the windows whose keys may be known."""
        if not len(let.cps):
            return
        own_of, prefix = let.owner(), prefix_hash(let.cps)
        place = anchors(let, prefix)
        own, gated = own_of[place], None
        for size in self.sizes:
            ok = place + size <= let.off[own + 1]
            if size > GATE and self.first is not None:
                if gated is None:
                    room = np.flatnonzero(place + GATE <= let.off[own + 1])
                    (k,) = walk_keys(let, place[room], GATE)
                    gated = np.zeros(len(place), bool)
                    gated[room[self.first[(k & GATE_MASK).astype(np.int64)]]] = True
                ok &= gated
            p, o = place[ok], own[ok]
            for k in walk_keys(let, p, size, self.bands(size)):
                met = self.knows(k)
                yield o[met], k[met]
        for length in self.lengths:
            st = window_starts(let, length)
            k = span_hash(prefix, st, st + length)
            met = self.knows(k)
            yield own_of[st[met]], k[met]


def table_of(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << GATE_BITS, bool)
    out[(keys & GATE_MASK).astype(np.int64)] = True
    return out


def _words(let: TextBatch, i: int) -> str:
    return let.cps[let.off[i] : let.off[i + 1]].tobytes().decode("utf-32-le", "surrogatepass")


def holds_passage(document: str, item: str, share: float = MIN_SHARE) -> bool:
    """Whether the document's letters hold an unbroken passage of at least that share of the item's."""
    need = shortest_passage(len(item), share)
    if not item or len(document) < need:
        return False
    # any such passage covers a multiple of step; a piece that is nowhere rules out all passages over it
    step = max(1, need // 2)
    for a in range(0, len(item) - step + 1, step):
        piece = item[a : a + step]
        at = document.find(piece)
        while at >= 0:
            left = 0
            while left < a and at - left > 0 and document[at - left - 1] == item[a - left - 1]:
                left += 1
            right, room = step, min(len(item) - a, len(document) - at)
            while right < room and document[at + right] == item[a + right]:
                right += 1
            if left + right >= need:
                return True
            at = document.find(piece, at + 1)
    return False


def reach(item: str, document: str, i: int, j: int, most: int, way: int) -> list[int]:
    """reach[e]: how many letters of the item from place i on (way 1) or before it (way -1) match the document from j with e edits."""

    def run(a: int, b: int) -> int:
        n = 0
        while 0 <= (x := i + way * (a + n)) < len(item) and 0 <= (y := j + way * (b + n)) < len(document) and item[x] == document[y]:
            n += 1
        return n

    if way < 0:
        i, j = i - 1, j - 1
    room = len(item) - i if way > 0 else i + 1
    far = {0: run(0, 0)}  # diagonal (item letters less document letters) -> furthest item letters
    best = [far[0]]
    for _ in range(most):
        nxt: dict[int, int] = {}
        for d, a in far.items():
            for to, b in ((d, a + 1), (d + 1, a + 1), (d - 1, a)):  # replaced, missing from the document, added to it
                if b <= room and b - to >= 0 and nxt.get(to, -1) < b:
                    nxt[to] = b
        far = {d: a + run(a, a - d) for d, a in nxt.items()}
        best.append(max([best[-1], *far.values()]))
    return best


def least_edits(document: str, item: str, share: float = MIN_SHARE, edits: float = 0.0) -> int | None:
    """The least number of edits at which the document holds a shortest passage of the item; None beyond the allowed ones."""
    if holds_passage(document, item, share):
        return 0
    most, need = most_edits(len(item), share, edits), shortest_passage(len(item), share)
    if not item or not most:
        return None
    # a passage with so few edits has this many of its k-grams within any place it stands in (the q-gram lemma)
    least_shared, width = need + 1 - GRAM - GRAM * most, need + most
    grams: dict[str, list[int]] = {}
    for i in range(len(item) - GRAM + 1):
        grams.setdefault(item[i : i + GRAM], []).append(i)
    shared = np.isin(_gram_hashes(document), _gram_hashes(item))
    run = np.concatenate(([0], np.cumsum(shared)))
    at = np.flatnonzero(shared)
    # k-grams in the window of that width that starts at each shared one; those of windows with enough of them are looked at
    full = run[np.minimum(at + width, len(shared))] - run[at] >= max(least_shared, 1)
    near = np.zeros(len(document) + width + 1, np.int64)
    near[at[full]] += 1
    near[at[full] + width] -= 1
    best, seen = most + 1, {}
    for j in np.flatnonzero(shared & (np.cumsum(near)[: len(shared)] > 0)).tolist():
        for i in grams.get(document[j : j + GRAM], ()):
            if seen.get(i - j, -1) >= j:  # within a run that is done
                continue
            ahead, back = reach(item, document, i, j, most, 1), reach(item, document, i, j, most, -1)
            seen[i - j] = j + ahead[0] - GRAM
            for e in range(min(best, most + 1)):
                if any(ahead[x] + back[e - x] >= need for x in range(e + 1)):
                    best = e
                    break
    return best if best <= most else None


def _gram_hashes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(c) - GRAM + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM if len(h) else 0):
            h = (h + c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
    return h


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, question: str, share: float = MIN_SHARE, edits: float = 0.0) -> DataFrame:
    """(key, item_key, edits) of every document that holds an item's question, whole or as a long enough passage, with the least edits."""
    rows = items.select(F.col(item_key).cast("string").alias("i"), F.col(question).alias("q")).where("i is not null and q is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("q")), F.lit(0))).first()[0]
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("d"), F.col(text).alias("t"))
    if size * 4 * (max(bands_for(s, edits) for s in SIZES) + 1) > INDEX_BYTES:
        return _leaks_by_join(docs, rows, kind, share, edits).toDF(key, item_key, "edits")
    got = rows.collect()
    let = TextBatch.of(pa.array([r.q for r in got], pa.large_string())).letters()
    plan = Plan.of(np.diff(let.off), share, edits)
    own, keys = plan.item_keys(let)
    order = np.argsort(keys, kind="stable")
    plan.known = table_of(keys)
    plan.first = None if edits else table_of(plan.item_keys(let, gate=True)[1])
    index = documents.sparkSession.sparkContext.broadcast((plan, keys[order], own[order], [r.i for r in got], [_words(let, i) for i in range(len(got))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, known, owners, ids, questions = index.value
        for whole in batches:
            for at, to in chunks(whole.column(1)):
                b = whole.slice(at, to - at)
                let = TextBatch.of(b.column(1)).letters()
                met = [np.zeros(0, np.int64)]
                for own, key_ in plan.document_keys(let):
                    lo, hi = np.searchsorted(known, key_, "left"), np.searchsorted(known, key_, "right")
                    times = hi - lo
                    hit = np.repeat(np.arange(len(key_)), times)
                    which = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
                    met.append(np.unique(own[hit] * len(ids) + owners[which]))
                at_doc, name, least, last, words = [], [], [], -1, ""
                for pair in np.unique(np.concatenate(met)).tolist():
                    d, i = divmod(pair, len(ids))
                    if d != last:
                        last, words = d, _words(let, d)
                    if (e := least_edits(words, questions[i], plan.share, plan.edits)) is not None:
                        at_doc.append(d)
                        name.append(ids[i])
                        least.append(e)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at_doc, pa.int64())), pa.array(name, pa.string()), pa.array(least, pa.int32())], ["d", "i", "edits"])

    found = docs.mapInArrow(run, f"d {kind}, i string, edits int")
    # one item id may stand in several rows
    return (found.groupBy("d", "i").agg(F.min("edits").alias("edits")) if len({r.i for r in got}) < len(got) else found).toDF(key, item_key, "edits")


def _leaks_by_join(documents: DataFrame, items: DataFrame, kind: str, share: float, edits: float) -> DataFrame:
    """The way for an index too large to broadcast: keys of both sides meet in a shuffle join."""

    def letters(items: DataFrame) -> np.ndarray:
        """Distinct numbers of letters of the items: a value for each length, whatever their number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at, to in chunks(whole.column(0)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.diff(TextBatch.of(whole.column(0).slice(at, to - at)).letters().off)))], ["n"])

        return items.select("q").mapInArrow(run, "n bigint").distinct().toArrow().column("n").to_numpy()

    plan = Plan.of(letters(items), share, edits)

    def item_rows(gate: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at, to in chunks(whole.column(1)):
                    b = whole.slice(at, to - at)
                    own, keys = plan.item_keys(TextBatch.of(b.column(1)).letters(), gate)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(keys.view(np.int64))], ["i", "k"])

        return items.mapInArrow(run, "i string, k bigint").distinct()

    def gate_of(rows: DataFrame) -> np.ndarray:
        """At most 2 ** GATE_BITS numbers reach the driver."""
        return table_of(rows.select(F.col("k").bitwiseAND(F.lit(int(GATE_MASK))).alias("g")).distinct().toArrow().column("g").to_numpy().astype(np.uint64))

    right = cut(item_rows(False))
    plan.known = gate_of(right)
    if not edits and any(s > GATE for s in plan.sizes):
        plan.first = gate_of(item_rows(True))
    sent = documents.sparkSession.sparkContext.broadcast(plan)

    def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in chunks(whole.column(1)):
                b = whole.slice(at, to - at)
                for own, keys in sent.value.document_keys(TextBatch.of(b.column(1)).letters()):
                    pairs = np.unique(np.stack([own, keys.view(np.int64)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["d", "k"])

    left = documents.mapInArrow(document_rows, f"d {kind}, k bigint")
    pairs = left.join(right, "k").select("d", "i").distinct()
    texts = pairs.join(documents, "d").join(items, "i").select("d", "i", "t", "q")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, asked = (TextBatch.of(b.column(c)).letters() for c in (2, 3))
            least = pa.array([least_edits(_words(docs, n), _words(asked, n), share, edits) for n in range(b.num_rows)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), least], ["d", "i", "edits"]).filter(least.is_valid())

    return texts.mapInArrow(check, f"d {kind}, i string, edits int").groupBy("d", "i").agg(F.min("edits").alias("edits"))
