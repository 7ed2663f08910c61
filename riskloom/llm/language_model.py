"""Document log-likelihoods by a gated recurrent network with class-factored output, and by word counts."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, slices
from riskloom.llm.toxicity import remainder
from riskloom.session import materialize

END = b""  # no word is empty
END_SLOT, OTHER_SLOT = 0, 1
CUT_AT_ONCE = 8_000_000  # bytes of texts


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def tokens_in(batch: pa.RecordBatch, text: str) -> tuple[pa.Array, np.ndarray]:
    """What ``tokens_of`` gives for each text (null: empty), in a row, and the number of tokens of each."""
    column = batch.column(batch.schema.get_field_index(text))
    column = column.take(pa.array(np.arange(len(column))))  # Arrow's lower-casing reads a cast slice at the wrong place
    column = pc.cast(column, options=pc.CastOptions(pa.large_string(), allow_invalid_utf8=True))
    solid = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    # a space at its end has a text end in an empty token; an empty text is one
    after = pc.if_else(pc.equal(pc.binary_length(solid), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    parts = pc.ascii_split_whitespace(pc.binary_join_element_wise(solid, after, pa.scalar("", pa.large_string())))
    return parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def places_in(tokens: pa.Array, words: list[bytes]) -> np.ndarray:
    """The place of each token in ``words``, -1 where it is none of them."""
    return pc.fill_null(pc.index_in(tokens, pa.array(words, pa.large_binary()).view(pa.large_string())), -1).to_numpy()


def rare_in(tokens: pa.Array, lengths: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of the tokens at the places ``at``: each text's own, once, and how often it has them."""
    coded = tokens.take(pa.array(at)).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    of = np.searchsorted(np.cumsum(lengths), at, side="right")
    pair, times = np.unique(of * n + coded.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(pair, n)
    edges = pa.array(np.searchsorted(doc, np.arange(len(lengths) + 1)), pa.int32())
    return (pa.ListArray.from_arrays(edges, coded.dictionary.take(pa.array(word)).cast(pa.binary())),
            pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())))


class Network:
    """Parameters by name, float32.

    table: what each slot adds to the three gates; loop: from state to gates; to_class, class_bias; to_word, word_bias by class.
    """

    NAMES = ("table", "gate_bias", "loop", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, state: int, classes: int, width: int) -> None:
        self.state, self.classes, self.width = state, classes, width

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h, c, k = self.state, self.classes, self.width
        return {"table": (c * k, 3 * h), "gate_bias": (3 * h,), "loop": (h, 3 * h), "to_class": (h, c), "class_bias": (c,), "to_word": (c, h, k), "word_bias": (c, k)}

    def fresh(self, mass: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
        """Small random weights, and biases that give each slot its share of all training tokens."""
        rng = np.random.default_rng(seed)
        p = {n: (rng.standard_normal(s) * (.1 if n in ("table", "loop") else .01)).astype(np.float32) for n, s in self.shapes().items()}
        mass = np.maximum(mass.reshape(self.classes, self.width), 1e-3)
        p["gate_bias"][:] = 0
        p["class_bias"] = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        p["word_bias"] = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        return p

    def pack(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[n].ravel() for n in self.NAMES])

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n in self.NAMES:
            shape = self.shapes()[n]
            size = int(np.prod(shape))
            out[n] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def gates(self, p) -> tuple[np.ndarray, np.ndarray]:
        """The table with the gate bias in it, and the loop, gate by gate, those of the first two gates negated."""
        parts = (p["table"] + p["gate_bias"], p["loop"])
        parts = tuple(np.ascontiguousarray(x.reshape(len(x), 3, self.state).transpose(1, 0, 2)) for x in parts)
        for x in parts:
            np.negative(x[:2], x[:2])
        return parts

    def run(self, p, slots: np.ndarray, h: np.ndarray, keep: list | None = None, starts: np.ndarray | None = None, gates=None):
        """States before each step of a (time, sequence) table of slots, and the state after the last.

        starts: where a new document begins, so that the state is empty before it.  gates: ``gates(p)``, if it is known.
        """
        table, loop = gates or self.gates(p)
        before = np.empty((*slots.shape, self.state), np.float32)
        x = table.take(slots, axis=1)
        some = np.zeros(len(slots), bool) if starts is None else starts.any(1)
        before[:1] = h
        for t in range(len(slots)):
            h = before[t]
            if some[t]:
                h[starts[t]] = 0
            g = h @ loop
            rz, new = g[:2], x[2, t]
            rz += x[:2, t]
            np.exp(rz, rz)
            rz += 1
            r, z = np.reciprocal(rz, rz)
            new += np.multiply(r, g[2], None if keep is not None else g[2])
            np.tanh(new, new)
            if keep is not None:
                keep.append((h, r, z, new, g[2]))
            h = np.subtract(h, new, before[t + 1] if t + 1 < len(slots) else None)
            h *= z
            h += new
        return before, h

    def log_prob(self, p, states: np.ndarray, slots: np.ndarray, grads: dict | None = None):
        """Natural log of P(class | state) P(word | class, state) for rows of states, and with ``grads`` the slope at the states."""
        kind = slots // self.width
        logits = p["to_class"].T @ states.T
        logits += p["class_bias"][:, None]
        out, d = _chosen(logits, kind, grads is not None)
        back = None
        if grads is not None:
            grads["to_class"] += states.T @ d.T
            grads["class_bias"] += d.sum(1)
            back = d.T @ p["to_class"].T
        # rows by class, so that each class multiplies a run of them and everything else takes all rows at once
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        kind, states = kind[order], states.take(order, axis=0)
        edges = np.searchsorted(kind, np.arange(self.classes + 1))
        some = np.flatnonzero(np.diff(edges))
        runs = [(c, slice(edges[c], edges[c + 1])) for c in some.tolist()]
        logits = np.empty((self.width, len(order)), states.dtype)
        for c, at in runs:
            np.matmul(p["to_word"][c].T, states[at].T, out=logits[:, at])
        logits += np.repeat(p["word_bias"][some].T, np.diff(edges)[some], axis=1)
        value, d = _chosen(logits, slots[order] - kind * self.width, grads is not None)
        out[order] += value
        if grads is not None and runs:
            into = np.empty_like(states)
            for c, at in runs:
                grads["to_word"][c] += states[at].T @ d[:, at].T
                np.matmul(d[:, at].T, p["to_word"][c].T, out=into[at])
            grads["word_bias"][some] += np.add.reduceat(d, edges[some], axis=1).T
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            back += into.take(place, axis=0)
        return out, back

    def slope(self, p, slots: np.ndarray, on: np.ndarray, h: np.ndarray, starts: np.ndarray | None = None, grads: dict | None = None):
        """(log probability, gradients, state after) of one window; back-propagation stops at its start.

        grads: where the gradients go, all zero.
        """
        steps: list = []
        before, after = self.run(p, slots, h, steps, starts)
        if grads is None:
            grads = {n: np.zeros(s, np.float32) for n, s in self.shapes().items()}
        n = self.state
        if on.all():
            value, into = self.log_prob(p, before.reshape(-1, n), slots.reshape(-1), grads)
            into = into.reshape(before.shape)
        else:
            value, at_states = self.log_prob(p, before[on], slots[on], grads)
            into = np.zeros_like(before)
            into[on] = at_states
        d = np.zeros_like(h)
        # slopes gate by gate; the last is that of the new state's table part, and ``looped`` that of its loop part
        gates = np.empty((3, *slots.shape, n), before.dtype)
        looped = np.empty_like(before)
        back = [np.ascontiguousarray(p["loop"][:, k * n : (k + 1) * n].T) for k in range(3)]
        some = np.zeros(len(slots), bool) if starts is None else starts.any(1)
        for t in range(len(slots) - 1, -1, -1):
            h0, r, z, new, gn = steps[t]
            rest = 1 - z
            dz = h0 - new
            dz *= d
            dz *= z
            np.multiply(dz, rest, out=gates[1, t])
            rest *= d
            new *= new
            dn = np.multiply(rest, np.subtract(1, new, new), out=gates[2, t])
            np.multiply(dn, r, out=looped[t])
            gn *= dn
            gn *= r
            np.multiply(gn, np.subtract(1, r, r), out=gates[0, t])
            d *= z
            d += gates[0, t] @ back[0]
            d += gates[1, t] @ back[1]
            d += looped[t] @ back[2]
            d += into[t]
            if some[t]:
                d[starts[t]] = 0
        flat = slots.ravel()
        order = np.argsort(flat.astype(np.uint16) if self.classes * self.width <= 1 << 16 else flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        sums = _run_sums(first, len(order))
        states = before.reshape(-1, n).T
        for k, x in enumerate((gates[0], gates[1], looped)):
            at = slice(k * n, (k + 1) * n)
            grads["loop"][:, at] += states @ x.reshape(-1, n)
            table = sums(gates[k].reshape(-1, n).take(order, axis=0))
            grads["table"][flat[order[first]], at] = table
            grads["gate_bias"][at] += table.sum(0)
        return float(value.sum()), grads, after


def _run_sums(first: np.ndarray, n: int, long: int = 24):
    """A function that sums each run of ``n`` rows; ``first`` has where runs begin.

    Runs of over ``long`` rows are summed one by one, the others side by side: first all first rows, then all second ones, and so on.
    """
    sizes = np.diff(first, append=n)
    ones = np.ones(n, np.float32)
    alone = [(i, slice(first[i], first[i] + sizes[i])) for i in np.flatnonzero(sizes > long).tolist()]
    rest = np.flatnonzero(sizes <= long)
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    begins, least = first[rest], -sizes[rest]
    turns = [begins[: np.searchsorted(least, -k, side="left")] + k for k in range(1, -least[0] if len(rest) else 0)]

    def sums(rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(first), rows.shape[1]), rows.dtype)
        for i, at in alone:
            out[i] = ones[: at.stop - at.start] @ rows[at]
        short = rows.take(begins, axis=0)
        for at in turns:
            short[: len(at)] += rows.take(at, axis=0)
        out[rest] = short
        return out

    return sums


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, rounded like numpy's sums of rows that lie one after another."""
    if len(x) % 8:
        return x.sum(0)
    x = x.reshape(-1, 8, x.shape[1]).sum(0)
    while len(x) > 1:
        x = x[::2] + x[1::2]
    return x[0]


def _chosen(by_place: np.ndarray, which: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log of the softmax of each column of logits at its place of ``which``, and its slope at the logits, which it overwrites."""
    by_place -= by_place.max(0)
    at = which * np.int64(len(which)) + np.arange(len(which))
    flat = by_place.reshape(-1)
    out = flat[at]
    np.exp(by_place, by_place)
    total = _sum(by_place)
    out -= np.log(total)
    if not slope:
        return out, None
    by_place /= total
    np.negative(by_place, by_place)
    flat[at] += 1
    return out, by_place


def lanes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one behind another in up to ``most`` lanes of about equal length: the documents lane by lane, and the length of each lane.

    The longest document says how many lanes are of use.  The longest lane comes first.
    """
    n = min(most, -(-int(lengths.sum()) // int(lengths.max())))
    heap = [(0, lane) for lane in range(n)]
    of = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        held, of[i] = heap[0]
        heapq.heapreplace(heap, (held + size, int(of[i])))
    place = np.empty(n, np.int64)
    heap.sort(reverse=True)
    place[[lane for _, lane in heap]] = np.arange(n)
    return np.argsort(place[of], kind="stable"), np.array([held for held, _ in heap])


def windows(lengths: np.ndarray, begins: np.ndarray, width: int):
    """(places in the flat array by time and sequence, mask, sequences still running) window by window; sequences come longest first."""
    for t in range(0, int(lengths[0]), width):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        at = np.arange(t, min(t + width, int(lengths[0])))[:, None]
        on = at < lengths[:n]
        yield np.where(on, begins[:n] + at, begins[:n]), on, n


def train(net: Network, flat: np.ndarray, slots_of: np.ndarray, lengths: np.ndarray, rate: float = .02, together: tuple[int, int] = (48, 128), width: int = 32,
          steps: int = 100) -> np.ndarray:
    """One pass of truncated back-propagation by Adam steps.

    slots_of: the slots of all documents in a row; lengths: of each document.  The row is cut into streams
    that run side by side; state is carried from window to window and emptied where a document begins.
    together: least and greatest number of streams; long rows have more of them, as long as ``steps`` windows remain, since wide steps cost less a token.
    """
    flat = flat.copy()
    slopes, first, second = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    p, grads = net.unpack(flat), net.unpack(slopes)
    begun = np.zeros(len(slots_of), bool)
    begun[np.cumsum(lengths) - lengths] = True
    least, most = together
    together = max(1, min(max(least, min(most, len(slots_of) // (width * steps))), len(slots_of) // width))
    each = -(-len(slots_of) // together)
    h = np.zeros((together, net.state), np.float32)
    for step, t in enumerate(range(0, each, width), 1):
        at = np.arange(t, min(t + width, each))[:, None] + each * np.arange(together)
        on = at < len(slots_of)
        at = np.where(on, at, 0)
        slopes[:] = 0
        h = net.slope(p, slots_of[at], on, h, begun[at], grads)[2]
        count = np.float32(on.sum())
        if not count:
            continue
        slopes /= count
        change = slopes - first
        change *= np.float32(.1)
        first += change
        np.multiply(slopes, slopes, change)
        change -= second
        change *= np.float32(.01)
        second += change
        np.divide(first, np.float32(1 - .9**step), change)
        change *= np.float32(rate)
        size = second / np.float32(1 - .99**step)
        np.sqrt(size, size)
        size += np.float32(1e-6)
        change /= size
        flat += change
    return flat


def log_probs(net: Network, p, slots_of: np.ndarray, lengths: np.ndarray, together: int = 512, width: int = 32) -> np.ndarray:
    """Natural log probability of each token of each whole sequence, laid out as in ``train``.

    Sequences run in lanes, so that a long one has others beside it until its end.
    """
    out = np.empty(len(slots_of), np.float32)
    if not len(lengths):
        return out
    docs, sizes = lanes(lengths, together)
    begins, ends = np.cumsum(sizes) - sizes, np.cumsum(lengths[docs])
    kind = np.int32 if len(slots_of) < 1 << 31 else np.int64
    places = np.repeat(((np.cumsum(lengths) - lengths)[docs] - ends + lengths[docs]).astype(kind), lengths[docs])
    places += np.arange(len(places), dtype=kind)
    begun = np.zeros(len(slots_of), bool)
    begun[ends - lengths[docs]] = True
    laid, gates = slots_of[places], net.gates(p)
    h = np.zeros((len(sizes), net.state), np.float32)
    for at, on, n in windows(sizes, begins, width):
        slots = laid[at]
        before, h = net.run(p, slots, h[:n], None, begun[at], gates)
        out[places[at[on]]] = net.log_prob(p, before[on], slots[on])[0]
    return out


def word_counts(docs: DataFrame, text: str = "text", most: int = 400_000) -> DataFrame:
    """(word, c) over every token of every text; counts fold in each task before they move."""
    def run(batches):
        held: list[pa.Table] = []
        for whole in batches:
            for batch in slices(whole, text, CUT_AT_ONCE):
                found = tokens_in(batch, text)[0].value_counts()
                held.append(pa.table({"word": found.field("values").view(pa.large_binary()), "c": found.field("counts")}))
                if sum(map(len, held)) > most:
                    held = [folded(held)]
                    if len(held[0]) > most:
                        yield from packed(held[0])
                        held = []
        if held:
            yield from packed(folded(held))

    def folded(held):
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"})

    def packed(counts):
        return counts.select(["word", "c"]).cast(pa.schema([("word", pa.binary()), ("c", pa.int64())])).combine_chunks().to_batches()

    return docs.select(F.col(text).alias(text)).mapInArrow(run, "word binary, c long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"))


def _averaged(spark, net: Network, flat: np.ndarray, chosen: DataFrame, text: str, slot_of, groups: int = 16) -> np.ndarray:
    """Each task trains from the same start on its documents; the results, weighted by tokens, are averaged in ``groups`` tasks."""
    shared = spark.sparkContext.broadcast((flat, slot_of))

    def fit(batches):
        start, slot_of = shared.value
        words = list(slot_of)
        slots = np.array([*slot_of.values(), OTHER_SLOT], np.int32)
        data, size = [], 0
        for whole in batches:
            for batch in slices(whole, text, CUT_AT_ONCE):
                tokens, lengths = tokens_in(batch, text)
                for x in np.split(slots[places_in(tokens, words)], np.cumsum(lengths)[:-1]):
                    data.append(x)
                    if (size := size + len(x)) > 4_000_000:  # a task's texts are trained on in turns of bounded size
                        start = train(net, start, np.concatenate(data), np.array([*map(len, data)]))
                        yield packed(start, size)
                        size, data = 0, []
        if data:
            yield packed(train(net, start, np.concatenate(data), np.array([*map(len, data)])), size)

    def packed(got, n):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() % groups
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([got.astype("<f4").tobytes()], pa.binary())], names=["g", "n", "p"])

    def mean(batches):
        total, sums = 0, None
        for batch in batches:
            for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                part = np.frombuffer(p, "<f4").astype(np.float64) * n
                total, sums = total + n, part if sums is None else sums + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.int64()), pa.array([(sums / total).astype("<f4").tobytes()], pa.binary())], names=["g", "n", "p"])

    kind = "g int, n long, p binary"
    rows = chosen.select(F.col(text).alias(text)).mapInArrow(fit, kind).repartition(groups, "g").mapInArrow(mean, kind).collect()
    if not rows:
        return flat
    return (sum(np.frombuffer(r["p"], "<f4").astype(np.float64) * r["n"] for r in rows) / sum(r["n"] for r in rows)).astype(np.float32)


def _in_round(text: str, k: int, rounds: int, share: float | None):
    """Whether round ``k`` trains on a text: on its own part of all texts, or with ``share`` on that share of them."""
    drawn = F.xxhash64(F.lit("share"), F.col(text))
    return F.pmod(drawn, F.lit(rounds)) == k if share is None else F.pmod(drawn, F.lit(1 << 20)) < int(share * (1 << 20))


def score(docs: DataFrame, keep: list[str], learnable, text: str = "text", state: int = 32, classes: int = 32, width: int = 32, share: float | None = None,
          rounds: int = 3, trust: float = .95, most_in_memory: int = 150_000) -> DataFrame:
    """``keep`` columns and counts and scores of each whole text (null: empty), learned from rows where ``learnable`` holds.

    Counts, classes and biases come from every learnable text, and so do the gradient steps: each of the ``rounds`` takes its own part of
    the texts, dealt by text hash, so that every text is used once.  ``share``: every round uses such a share of the texts instead.
    The most frequent words have slots of their own in the network; the others share one, and a word's
    part of it follows its count.  A token's probability is ``trust`` times the network's plus the rest times that of the counts.
    The ``most_in_memory`` most frequent words' counts are broadcast; the words beyond are looked up by a join,
    so any vocabulary will do.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in SCORED]
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    learned = rows.where(learnable)
    vocabulary = materialize(word_counts(learned, text), "counts")
    row = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = row["n"], row["v"]
    divisor = n + .5 * (v + 1)
    common = [(bytes(r["word"]), r["c"]) for r in vocabulary.orderBy(F.desc("c"), "word").limit(most_in_memory).collect()]
    known = dict(common)
    net = Network(state, classes, width)
    own = [w for w, _ in common if w != END][: classes * width - 2]
    slot_of = {END: END_SLOT} | {w: i + 2 for i, w in enumerate(own)}
    mass = np.zeros(classes * width)
    for w, i in slot_of.items():
        mass[i] = known.get(w, 0) + .5
    other = max(divisor - mass.sum(), .5)
    mass[OTHER_SLOT] = other
    flat = net.pack(net.fresh(mass))
    for k in range(rounds if n else 0):
        flat = _averaged(spark, net, flat, learned.where(_in_round(text, k, rounds, share)), text, slot_of)
    shared = spark.sparkContext.broadcast((flat, known, slot_of, divisor, other))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in keep]).schema)
    schema = (schema + ", " if schema else "") + "n_tokens long, n_known long, base double, model double, rare array<binary>, times array<long>"

    def run(batches):
        flat, known, slot_of, divisor, other = shared.value
        p = net.unpack(flat)
        # a word's number leads to its slot, its log count, and what the counts alone give; the last entry is for words that aren't held
        words, missing = list(known), len(known)
        slot = np.array([*(slot_of.get(w, OTHER_SLOT) for w in words), OTHER_SLOT], np.int32)
        unslotted = slot == OTHER_SLOT
        log_count = np.array([*(np.log10(c + .5) for c in known.values()), 0.0])
        plain = (1 - trust) * np.where(unslotted, 1.0, 10.0**log_count) / divisor
        gain, extra = trust / np.where(unslotted, other, 1.0), np.where(unslotted, log_count, 0.0)
        for whole in batches:
            for batch in slices(whole, text, 32_000_000):  # many lanes side by side
                parts = []
                for part in slices(batch, text, CUT_AT_ONCE):
                    tokens, lengths = tokens_in(part, text)
                    numbers = places_in(tokens, words)
                    numbers = np.where(numbers < 0, np.int32(missing), numbers)
                    parts.append((part, lengths, numbers, *rare_in(tokens, lengths, np.flatnonzero(numbers == missing))))
                chances = log_probs(net, p, np.concatenate([slot[x[2]] for x in parts]), np.concatenate([x[1] for x in parts]))
                end = 0
                for part, lengths, numbers, rares, times in parts:
                    end += len(numbers)
                    begins = np.cumsum(lengths) - lengths
                    model = np.log10(gain[numbers] * np.exp(chances[end - len(numbers) : end]) + plain[numbers]) + extra[numbers]
                    sums = [np.add.reduceat(x, begins) for x in ((numbers != missing).astype(np.int64), log_count[numbers], model)]
                    values = [pa.array(lengths), pa.array(sums[0]), pa.array(sums[1] - lengths * np.log10(divisor)), pa.array(sums[2]), rares, times]
                    arrays = [part.column(part.schema.get_field_index(c)) for c in keep] + values
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "n_known", "base", "model", "rare", "times"])

    scored = materialize(rows.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("__row", F.col("r.rare").alias("w"), F.col("r.times").alias("k"))
    found = rare.join(vocabulary, rare["w"] == vocabulary["word"], "left").groupBy(F.col("__row").alias("r")).agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(.5))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("met"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found, scored["__row"] == found["r"], "left").select(
        *[F.col(f"`{c}`") for c in keep], "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


SCORED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def not_held_out(doc: str = "doc_id"):
    """Rows to learn from: all whose crc32 of the id, modulo 5, is not 1; a null id is never learned from."""
    return F.coalesce(remainder(doc, 5) != 1, F.lit(False))
