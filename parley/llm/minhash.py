"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures (operator 5).

A document's set of word shingles gives a signature of b-bit minimum hashes. The signature is split
into chunks; signatures that differ in few enough places agree in some chunk but for an allowed number
of errors, by the pigeonhole principle. A key for each chunk and each choice of places that may differ
so brings together all pairs within `guaranteed_distance`, and the number of chunks is such that a pair at
the similarity asked for is missed with a chance of at most `MISS`.

Documents with equal sets are one node. The nodes of a key are first held against one of them; what is
linked then forms components. Nodes that still share keys across components make up clumps. All of a clump
are held against its middle, the hub; then only what sets each apart from the hub is compared, rare elements
first, which gives the few pairs of different components that can be similar enough at all. So large
groups of copies cost a few comparisons a document, near misses of one text are not paired, and no link
between components is lost. All links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACES, settings, stash
from parley.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 80
#: Places of a chunk and how many of them may differ.
PLACES = 6
ERRORS = 1
#: Chance to miss a pair at the threshold, by its keys and by the distance of its signature.
MISS = 1e-5
FAR = 1e-7
#: Words of 64 bits of the filter that tells which texts to read again: 2 MB.
FILTER_WORDS = 1 << 18
#: Bytes of text that are hashed at a time.
PART_BYTES = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finalizer of the public SplitMix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_OF_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_OF_BYTE[list(SPACES.encode())] = 0
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
_BASE = _U(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order; A-Z count as a-z. A long text is hashed
    in stretches, as the work takes many times its bytes."""
    if sum(map(len, texts)) <= 2 * PART_BYTES:
        return _word_hashes(texts)
    return [
        _word_hashes([t])[0] if len(t) <= PART_BYTES
        else np.concatenate([_word_hashes([part])[0] for part in _stretches(t)])
        for t in texts
    ]


def _stretches(raw: bytes) -> Iterator[bytes]:
    """The parts of a text, cut at white space."""
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        while end < len(raw):
            cut = max(raw.rfind(c.encode(), at, end) for c in SPACES) + 1
            if cut > at:
                end = cut
                break
            end += PART_BYTES
        yield raw[at:end]
        at = end


def _word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    data = b" ".join(texts).lower() + b" "
    codes = np.frombuffer(data, np.uint8)
    gap = _IS_SPACE[codes]
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(begins):
        return [np.empty(0, _U) for _ in texts]
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    # Places count from the start of the word; blanks, whose value is 0, do not matter.
    place = np.arange(len(codes))
    place[begins[0] :] -= np.repeat(begins, np.diff(begins, append=len(codes)))
    longest = int((ends - begins).max())
    place = np.minimum(place, longest)
    values = _OF_BYTE[codes] * _powers(longest + 1)[place]
    words = _mix(np.add.reduceat(values, begins) + (ends - begins).astype(_U))
    bounds = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return [words[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of `size` words in a row; of all words where there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    found = []
    for low in range(0, len(words) - size + 1, PART_BYTES):
        some = words[low : low + PART_BYTES + size - 1]
        n = len(some) - size + 1
        out = np.full(n, _U(size))
        for i in range(size):
            out = _mix(out * _BASE + some[i : i + n])
        found.append(np.unique(out))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def chunks_for(percent: int) -> int:
    """So many chunks that a pair at the threshold is missed by all with a chance of MISS at most."""
    j = percent / 100
    found = sum(
        math.comb(PLACES, e) * (1 - j) ** e * j ** (PLACES - e) for e in range(ERRORS + 1)
    )
    return max(1, math.ceil(math.log(MISS) / math.log(1 - found))) if found < 1 else 1


def guaranteed_distance(chunks: int) -> int:
    """Signatures that differ in at most so many places share a key."""
    return chunks * (ERRORS + 1) - 1


def largest_distance(places: int, percent: int) -> int:
    """Pairs at the threshold differ in more places with a chance of FAR at most."""
    miss, tail, d = 1 - percent / 100, 1.0, -1
    while tail > FAR:
        d += 1
        tail -= math.comb(places, d) * miss**d * (1 - miss) ** (places - d)
    return d


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=_U) * _BASE)
    return seeds[:n] | _U(1), seeds[n:]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least value under each permutation."""
    least = np.full(len(a), np.iinfo(_U).max, _U)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096, None] * a + b
        least = np.minimum(least, part.min(axis=0))
    return (_mix(least) >> _U(48)).astype("<u2")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """The rows of a batch in parts of limited size: ids and texts."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        ids.append(doc_id.as_py())
        texts.append(raw)
        held += len(raw)
        if held > PART_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


_SIGNED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
        ("set_id", pa.binary()), ("text_id", pa.int64()), ("signature", pa.binary()),
        ("text_sha256", pa.binary()),
    ]
)


def _sign(size: int, places: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(places)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts in _texts(batch):
                out = []
                for doc_id, raw, words in zip(ids, texts, word_hashes(texts), strict=True):
                    found = shingles(words, size)
                    known = len(found) > 0
                    out.append(
                        (
                            row, doc_id, len(found),
                            _digest(found.tobytes(), 16) if known else None,
                            int.from_bytes(_digest(raw, 8), "little", signed=True),
                            signature(found, a, b).tobytes() if known else None,
                            hashlib.sha256(raw).digest(),
                        )
                    )
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), _SIGNED)], schema=_SIGNED
                )

    return sign


def _keys(chunks: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column(1).to_pylist())
            of = np.frombuffer(raw, "<u2").reshape(batch.num_rows, chunks * PLACES).astype(_U)
            node = batch.column(0).to_numpy()
            for c in range(chunks):
                chunk = of[:, c * PLACES : (c + 1) * PLACES]
                for free in range(PLACES):
                    key = np.full(len(node), _U(c * PLACES + free + 1))
                    for i in range(PLACES):
                        if i != free:
                            key = _mix(key * _BASE + chunk[:, i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"]
                    )

    return keys


def _near(limit: int, percent: int):
    """Keep pairs whose sizes allow the similarity and whose signatures are not too far apart."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(
                    batch.num_rows, -1
                )
                for c in ("sig_a", "sig_b")
            )
            differ = (one != two).sum(axis=1)
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = (differ <= limit) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a").filter(pa.array(ok)),
                    batch.column("b").filter(pa.array(ok)),
                    pa.array(differ[ok].astype(np.int64)),
                ],
                ["a", "b", "differ"],
            )

    return near


def _read_sets(size: int, words: np.ndarray):
    """Sets of the texts that the filter lets through, each once in a task."""
    schema = pa.schema([("set_id", pa.binary()), ("shingles", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in _texts(batch):
                wanted = [t for t in texts if _listed(words, _digest(t, 8))]
                out = []
                for found in word_hashes(wanted) if wanted else []:
                    data = shingles(found, size).tobytes()
                    key = _digest(data, 16)
                    if key not in seen:
                        seen.add(key)
                        out.append((key, data))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.binary()) for c in zip(*out)], schema=schema
                    )

    return read


_ELEMENTS = (
    "clump long, base int, node long, component long, n int, delta int, element long"
)


def _differences(percent: int):
    """The elements in which a node's set differs from the hub's (base 1), an element a row.

    A hub of more than twice as many elements would only make the differences long: there, the set
    itself is given (base 0). Around that limit both are, so that nodes that are similar enough always
    meet in one of the forms.
    """

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("clump", "node", "component")]
            held = 0
            out: list[tuple] = []
            parts: list[np.ndarray] = []
            for clump, node, component, one, hub in zip(
                *ids, batch.column("shingles"), batch.column("hub_shingles"), strict=True
            ):
                own = np.frombuffer(one.as_buffer(), _U)
                of_hub = np.frombuffer(hub.as_buffer(), _U)
                forms = []
                if len(of_hub) <= 2 * len(own):
                    forms.append((1, np.setxor1d(own, of_hub, assume_unique=True)))
                if 100 * len(of_hub) > 2 * percent * len(own):
                    forms.append((0, own))
                for base, found in forms:
                    if len(found):
                        out.append((clump, base, node, component, len(own), len(found)))
                        parts.append(found)
                        held += len(found)
                if held > 1 << 18:
                    yield _element_rows(out, parts)
                    out, parts, held = [], [], 0
            if out:
                yield _element_rows(out, parts)

    return differences


def _element_rows(nodes: list[tuple], parts: list[np.ndarray]) -> pa.RecordBatch:
    sizes = [len(x) for x in parts]
    kinds = (np.int64, np.int32, np.int64, np.int64, np.int32, np.int32)
    columns = [
        pa.array(np.repeat(np.array(c, k), sizes)) for c, k in zip(zip(*nodes), kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(np.concatenate(parts).view(np.int64))],
        ["clump", "base", "node", "component", "n", "delta", "element"],
    )


def _listed(words: np.ndarray, text_id: bytes) -> bool:
    x = int.from_bytes(text_id, "little")
    return bool(int(words[(x >> 32) % len(words)]) >> (x & 63) & 1)


def _filter_of(text_ids: DataFrame) -> np.ndarray:
    """One bit for each text, in a table of FILTER_WORDS words whatever the number of texts."""
    unsigned = F.shiftrightunsigned("text_id", 32)
    bit = F.col("text_id").bitwiseAND(F.lit(63)).cast("int")
    rows = (
        text_ids.groupBy(F.pmod(unsigned, F.lit(FILTER_WORDS)).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_WORDS, np.int64)
    for word, bits in rows:
        out[word] = bits
    return out.view(_U)


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, one, two in zip(
                batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                batch.column("set_a"), batch.column("set_b"), strict=True,
            ):
                one = np.frombuffer(one.as_buffer(), _U)
                two = np.frombuffer(two.as_buffer(), _U)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

    return confirm


class _Job:
    """The tables of one run."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.words, self.percent = words, percent
        self.chunks = chunks_for(percent)
        self.places = self.chunks * PLACES
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
        fields = (
            "row long, doc_id long, n_shingles long, set_id binary, text_id long, signature binary, "
            "text_sha256 binary"
        )
        self.rows = stash(
            self.texts.mapInArrow(_sign(words, self.places), fields), "signatures"
        )
        self.nodes = stash(
            self.rows.filter("n_shingles > 0")
            .groupBy("set_id")
            .agg(
                F.min("row").alias("node"),
                F.min("text_id").alias("text_id"),
                F.min("n_shingles").alias("n"),
                F.min("signature").alias("signature"),
            ),
            "nodes",
        )

    def members(self) -> DataFrame:
        """(key, node) of the keys that several nodes have, with the smallest of them."""
        keys = self.nodes.select("node", "signature").mapInArrow(
            _keys(self.chunks), "key long, node long"
        )
        shared = stash(
            keys.groupBy("key")
            .agg(F.min("node").alias("hub"), F.max("node").alias("_last"))
            .filter("hub <> _last")
            .select("key", "hub"),
            "shared",
        )
        return stash(keys.join(shared, "key"), "members")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that may be similar enough, with the places that differ."""
        sides = [
            self.nodes.select(
                F.col("node").alias(x), F.col("n").alias(f"n_{x}"),
                F.col("signature").alias(f"sig_{x}"),
            )
            for x in "ab"
        ]
        limit = largest_distance(self.places, self.percent)
        return stash(
            pairs.join(sides[0], "a")
            .join(sides[1], "b")
            .mapInArrow(_near(limit, self.percent), "a long, b long, differ long"),
            "near",
        )

    def sets(self, nodes: DataFrame) -> DataFrame:
        """`node` and `shingles` of some nodes, from the texts."""
        wanted = stash(
            self.nodes.join(nodes, "node", "left_semi").select("node", "set_id", "text_id"),
            "wanted",
        )
        return stash(
            self.texts.mapInArrow(
                _read_sets(self.words, _filter_of(wanted)), "set_id binary, shingles binary"
            )
            .dropDuplicates(["set_id"])
            .join(wanted.select("node", "set_id"), "set_id")
            .select("node", "shingles"),
            "sets",
        )

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        with settings(self.texts.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="256"):
            return stash(
                pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(
                    _confirm(self.percent), "a long, b long"
                ),
                "links",
            )

    def run(self) -> DataFrame:
        """`node` and `component` for the nodes that are linked with another."""
        members = self.members()
        stars = self.near(
            members.filter("node <> hub")
            .select(F.col("node").alias("a"), F.col("hub").alias("b"))
            .distinct()
        )
        best = self.nearest(stars)
        ends = best.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        links = self.confirmed(best, self.sets(ends))
        labels = components(links)
        left = self.open_keys(members.select("key", "node"), labels)
        if left.isEmpty():
            return labels
        sets = self.sets(left.select("node").distinct())
        clumps = self.clumps(left)
        # All that share a key with others are held against the middle of their clump.
        tries = clumps.filter("node <> hub").select(
            F.col("node").alias("a"), F.col("hub").alias("b")
        )
        links = stash(links.unionAll(self.confirmed(self.apart(tries, labels), sets)), "links")
        labels = components(links)
        rest = self.apart(self.overlapping(self.elements(clumps, labels, sets)), labels)
        if rest.isEmpty():
            return labels
        return components(links.unionAll(self.confirmed(rest, sets)))

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs (a, b) whose nodes are not known to be of one component."""
        for x in "ab":
            of = labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
            pairs = pairs.join(of, x, "left").withColumn(f"_{x}", F.coalesce(f"_{x}", x))
        return stash(pairs.filter("_a <> _b").select("a", "b"), "apart")

    def clumps(self, members: DataFrame) -> DataFrame:
        """`node, clump, hub`: nodes are of one clump if keys lead from one to the other. The hub
        is the node that meets most others on its keys."""
        keys = stash(
            members.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("others")),
            "key-sizes",
        )
        met = stash(members.select("key", "node").join(keys, "key"), "met")
        clumps = components(met.select(F.col("node").alias("a"), "b"))
        degrees = met.groupBy("node").agg(F.sum("others").alias("others"))
        known = stash(
            clumps.select("node", F.col("component").alias("clump")).join(degrees, "node"), "degrees"
        )
        hubs = stash(
            known.groupBy("clump").agg(F.max(F.struct("others", "node")).alias("hub")).select(
                "clump", F.col("hub.node").alias("hub")
            ),
            "hubs",
        )
        return stash(known.select("node", "clump").join(hubs, "clump"), "clumps")

    def elements(self, clumps: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """What sets the nodes apart from the hub of their clump, an element a row.

        Only clumps that still have nodes of several components are looked at.
        """
        nodes = stash(
            clumps.join(labels, "node", "left").withColumn(
                "component", F.coalesce("component", "node")
            ),
            "clumped",
        )
        several = stash(
            nodes.groupBy("clump")
            .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
            .filter("_low <> _high")
            .select("clump"),
            "several",
        )
        hub_sets = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
        return stash(
            nodes.join(several, "clump", "left_semi")
            .join(sets, "node")
            .join(hub_sets, "hub")
            .select("clump", "node", "component", "shingles", "hub_shingles")
            .mapInArrow(_differences(self.percent), _ELEMENTS),
            "elements",
        )

    def overlapping(self, elements: DataFrame) -> DataFrame:
        """Pairs (a, b) of a clump, in different components, that may be similar enough.

        With x and y the sets of two nodes and D what sets each apart from the hub, D(x) and D(y) differ
        just where x and y do. So a pair that is similar enough has a least number of elements of D in common.
        In any order of elements, the first that they have in common then stands, in both, so far
        before the end that the others can follow. Rare elements come first; those of one component only are
        never in common, and are just counted.
        """
        group = ["clump", "base", "element"]
        shared = stash(
            elements.groupBy(*group)
            .agg(
                F.count("*").alias("found"),
                F.min("component").alias("_low"),
                F.max("component").alias("_high"),
            )
            .filter("_low <> _high")
            .select(*group, "found"),
            "shared-elements",
        )
        p = self.percent
        private = F.col("delta") - F.size("listed")
        # Those further back are the first in common of no pair.
        reach = F.floor(F.col("n") * (100 - p) / p).cast("int") + 1 - private
        listed = F.array_sort(F.collect_list(F.struct("found", "element")))
        node = ["clump", "base", "node", "component", "n", "delta"]
        placed = stash(
            elements.join(shared, group)
            .groupBy(*node)
            .agg(listed.alias("listed"))
            .withColumn("private", private)
            .withColumn("first", F.slice("listed", F.lit(1), F.greatest(reach, F.lit(0))))
            .select(*node, "private", F.posexplode("first").alias("at", "e"))
            .select(
                *node, F.col("e.element").alias("element"),
                (F.col("private") + F.col("at") + 1).alias("place"),
            ),
            "placed",
        )
        x, y = (
            placed.select(*group, *(F.col(c).alias(f"{c}_{s}") for c in _PLACED)) for s in "xy"
        )
        sizes = F.col("n_x") + F.col("n_y")
        most = F.floor(sizes * (100 - p) / (100 + p))
        deltas = F.col("delta_x") + F.col("delta_y")
        least = F.greatest(F.floor((deltas - most + 1) / 2), F.lit(1))
        possible = (
            (F.col("node_x") > F.col("node_y"))
            & (F.col("component_x") != F.col("component_y"))
            & (100 * F.least("n_x", "n_y") >= p * F.greatest("n_x", "n_y"))
            & (F.col("place_x") <= F.col("delta_x") - least + 1)
            & (F.col("place_y") <= F.col("delta_y") - least + 1)
        )
        return (
            x.join(y, group)
            .filter(possible)
            .select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
            .distinct()
        )

    @staticmethod
    def nearest(pairs: DataFrame) -> DataFrame:
        """For each `a` the pair whose signatures differ least."""
        best = pairs.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("best"))
        return stash(best.select("a", F.col("best.b").alias("b")), "nearest")

    @staticmethod
    def open_keys(members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members, with `component`, of keys that have nodes of different components."""
        known = stash(
            members.join(labels, "node", "left").withColumn(
                "component", F.coalesce("component", "node")
            ),
            "known",
        )
        keys = stash(
            known.groupBy("key")
            .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
            .filter("_low <> _high")
            .select("key"),
            "open",
        )
        return stash(known.join(keys, "key", "left_semi"), "left")


_PLACED = ("node", "component", "n", "delta", "place")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by a similarity of shingle sets of at least `percent` of 100.

    One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` (the smallest id that links reach,
    its own included) and `kept` (`doc_id` is `component_id`). Words are parted by ASCII white space, A-Z
    count as a-z; with fewer words than a shingle has, all of them are one shingle. Texts without words,
    null texts among them, have an empty set and are linked with nothing. A null id is larger than any other; a
    group of null ids alone has a null component, and all of it is kept. Rows that repeat an id are kept or
    dropped together. Other columns are ignored; an empty table gives no rows. `docs` should be a stored table,
    as it is read twice.
    """
    rows = _components(docs, shingle_words, percent, id_col, text_col)
    return rows.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _components(
    docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str
) -> DataFrame:
    """The rows with `component_id`, `text_sha256`, and `keep_sha256`: of the texts with the smallest
    id of a component, the one with the smallest digest."""
    job = _Job(docs, shingle_words, percent, id_col, text_col)
    nodes = job.nodes.select("set_id", "node")
    labels = job.run().withColumnRenamed("node", "_node")
    of_set = stash(
        nodes.join(labels, F.col("node") == F.col("_node"), "left").select(
            "set_id", F.coalesce("component", "node").alias("component")
        ),
        "sets-of-components",
    )
    grouped = stash(
        job.rows.filter("n_shingles > 0")
        .join(of_set, "set_id")
        .select("doc_id", "n_shingles", "component", "text_sha256"),
        "grouped",
    )
    # Null ids last.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256"))
    least = stash(
        grouped.groupBy("component")
        .agg(first.alias("first"))
        .select(
            "component",
            F.col("first.doc_id").alias("component_id"),
            F.col("first.text_sha256").alias("keep_sha256"),
        ),
        "least",
    )
    columns = ["doc_id", "n_shingles", "component_id", "text_sha256", "keep_sha256"]
    linked = grouped.join(least, "component").select(*columns)
    alone = job.rows.filter("n_shingles = 0").select(
        "doc_id",
        "n_shingles",
        F.col("doc_id").alias("component_id"),
        "text_sha256",
        F.col("text_sha256").alias("keep_sha256"),
    )
    return linked.unionAll(alone)


def drop_near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One text of each group of `near_duplicates`: that of the smallest id, then of the smallest digest.

    Rows are told apart by id and text, so texts that share an id are kept or dropped each by itself; rows
    that are the same in both stay together. Rows without an id are all kept.
    """
    dropped = stash(
        _components(docs, shingle_words, percent, "doc_id", "text")
        .filter("doc_id <> component_id or text_sha256 <> keep_sha256")
        .select(F.col("doc_id").alias("_dropped"), F.col("text_sha256").alias("_dropped_text"))
        .filter("_dropped is not null")
        .distinct(),
        "dropped",
    )
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    on = (F.col("doc_id") == F.col("_dropped")) & (F.col("_row_text") == F.col("_dropped_text"))
    return docs.withColumn("_row_text", digest).join(dropped, on, "left_anti").drop("_row_text")
