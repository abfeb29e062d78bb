"""Document scores by masked pseudo-likelihood (operator 1).

A small network in numpy predicts every word from the two words on either side; a document's score is the sum
of the logarithms of these conditional probabilities. Words are counted over the whole corpus; the most frequent
have ids of their own (their number grows with the corpus), the others share hashed ids. The ids are the leaves of a
Huffman tree of their counts, and p(id | context) is the product of the decisions on the way to its leaf (a
hierarchical softmax), so that a word costs some log2 of the vocabulary, whatever its size. What a shared id
gets is dealt among its words by their counts in the corpus: p(word | context) = p(id | context) n(word) / (n(id) + 1),
where the 1 is kept for words that the corpus doesn't have. So every word has a probability of its own.

Every position trains once: each round takes a share of the rows, the rounds' shares are disjoint and together all rows.
In a round, each trainer improves the common model on its rows; the trainers' models are averaged in a
reduction tree, weighted by the positions they saw. A trainer has some TRAINER positions at least, however many files
or partitions hold them, and more for a larger model, so that models take less room than the ids. The work of
training grows with the corpus, the model, which goes to every task, with the cube root of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, lean, materialize
from .language_id import mix64
from .tokens import blocks

#: Ids: KNOWN frequent words, then HASHED shared ids, then one for "outside". Over BASE words of text, KNOWN grows with
#: the cube root of the words.
KNOWN, HASHED, BASE = 7168, 1024, 1 << 22
SIDE, DIM, HIDDEN = 2, 16, 16
#: Decisions (the most frequent ones) that are computed for all words of a step at once.
TOP = 64
#: Rounds of training, which share out all rows; positions of a step (more for a vocabulary of more than twice as many); step size.
ROUNDS, STEP, RATE, SEED = 3, 1 << 14, 0.1, 1
#: Positions of a trainer, and positions for each parameter of its model, at least.
TRAINER, PER_PARAMETER = 1 << 21, 4
#: Models that one task of the reduction tree adds up, and the slices of a model that are added apart.
FAN_IN, SLICES = 16, 16
#: Positions scored at a time.
CHUNK = 1 << 14
#: Bytes of hashes of words with shared ids that are sorted together.
GROUP_BYTES = 1 << 20
#: Bytes of text whose words are found at a time, and the base of their hashes.
BLOCK, MULTIPLIER = 1 << 20, 0x9E3779B97F4A7C15
OFFSETS = np.array([o for o in range(-SIDE, SIDE + 1) if o])


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of sizes entries from starts on: the run of each entry, and its place."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def sums_by(keys: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each key below size. Column by column, since that is numpy's fastest way."""
    return np.stack([np.bincount(keys, c, minlength=size) for c in np.ascontiguousarray(rows.T)], axis=1)


class Tree:
    """A Huffman tree over ids: for each id the decisions on its way, as (number, whether the heavier side was taken).

    Decisions are numbered by falling weight, so that the first TOP hang together at the root.
    """

    def __init__(self, counts: np.ndarray):
        v = len(counts)
        order = np.argsort(counts, kind="stable")
        leaf, inner, up, heavy = (counts[order] + 0.5).tolist(), [], np.zeros(2 * v - 1, np.int64), np.zeros(2 * v - 1, bool)
        order = order.tolist()
        i = j = 0
        for k in range(v - 1):  # of leaves and inner nodes, both by rising weight, the two lightest
            weight = 0.0
            for side in (False, True):
                if i < v and (j >= k or leaf[i] <= inner[j]):
                    node, weight, i = order[i], weight + leaf[i], i + 1
                else:
                    node, weight, j = v + j, weight + inner[j], j + 1
                up[node], heavy[node] = v + k, side
            inner.append(weight)
        self.weights = np.array(inner[::-1])
        decisions, taken, owner = [], [], []
        node, ids = np.arange(v), np.arange(v)
        while len(node) and v > 1:  # all ids climb together
            decisions.append(2 * v - 2 - up[node])
            taken.append(heavy[node])
            owner.append(ids)
            node = up[node]
            ids, node = ids[node < 2 * v - 2], node[node < 2 * v - 2]
        decision, side, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (decisions, taken, owner))
        self.log_odds = np.zeros(max(v - 1, 1))
        below = np.bincount(decision[side.astype(bool)], counts[of[side.astype(bool)]] + 0.5, minlength=max(v - 1, 1))
        if v > 1:
            self.log_odds = np.log(below / (self.weights - below))
        self.parts = []
        for part in (decision < TOP, decision >= TOP):
            order = np.argsort(of[part], kind="stable")
            sizes = np.bincount(of[part], minlength=v)
            self.parts.append((np.cumsum(sizes) - sizes, sizes, decision[part][order].astype(np.int32), np.where(side[part][order], np.float32(1), np.float32(-1))))

    def top(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of target, decision, side as 1 or -1) of all decisions that are of the first TOP."""
        starts, sizes, decision, side = self.parts[0]
        row, at = spread(starts.take(target), sizes.take(target))
        return row, decision.take(at), side.take(at)

    def deep(self, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(decisions, sides) of the others, one step of the way at a time, for the first rows only. Targets stand by falling number of them."""
        starts, sizes, decision, side = self.parts[1]
        at, left = starts.take(target), sizes.take(target)
        rows = len(target) - np.cumsum(np.bincount(left)) if len(target) else []
        for step, n in enumerate(rows):
            if n:
                yield decision.take(at[:n] + step), side.take(at[:n] + step)

    def order(self, target: np.ndarray) -> np.ndarray:
        """The order that deep wants."""
        return np.argsort(np.uint16(1 << 15) - self.parts[1][1].astype(np.uint16).take(target), kind="stable")


def shapes(vocab: int) -> dict[str, tuple[int, ...]]:
    """The parameters of a network over vocab ids."""
    return {"embed": (vocab + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "node": (max(vocab - 1, 1), HIDDEN), "bias": (max(vocab - 1, 1),)}


def length(vocab: int) -> int:
    return sum(int(np.prod(x)) for x in shapes(vocab).values())


class Net:
    """The parameters as views of one float32 vector."""

    def __init__(self, flat: np.ndarray, tree: Tree):
        self.flat, self.tree, at = flat, tree, 0
        self.vocab = len(tree.parts[0][0])
        for name, shape in shapes(self.vocab).items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def initial(counts: np.ndarray) -> Net:
        """Small random weights; the biases give the corpus's word frequencies."""
        rng = np.random.default_rng(SEED)
        net = Net(np.zeros(length(len(counts)), np.float32), Tree(counts))
        for name, size in (("embed", 0.3), ("w", 0.1), ("node", 0.1)):
            x = getattr(net, name)
            x[...] = rng.standard_normal(x.shape, np.float32) * np.float32(size)
        net.bias[:] = net.tree.log_odds
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed.take(context.ravel(), axis=0).reshape(len(context), -1)
        return x, np.tanh(x @ self.w + self.b)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of p(target | context), in the order given."""
        order = self.tree.order(target)
        target = target.take(order)
        _, h = self.hidden(context.take(order, axis=0))
        row, k, side = self.tree.top(target)
        odds = h @ self.node[:TOP].T + self.bias[:TOP]
        out = -np.bincount(row, np.log(1 + np.exp(-side * odds.ravel().take(row * odds.shape[1] + k))), minlength=len(target))
        for k, side in self.tree.deep(target):
            n = len(k)
            out[:n] -= np.log(1 + np.exp(-side * (np.einsum("ij,ij->i", h[:n], self.node.take(k, axis=0)) + self.bias.take(k))))
        result = np.empty(len(out), np.float64)
        result[order] = out
        return result

    def gradient(self, context: np.ndarray, target: np.ndarray) -> Net:
        """Of the mean negative log probability."""
        grad = Net(np.zeros_like(self.flat), self.tree)
        order = self.tree.order(target)
        context, target = context.take(order, axis=0), target.take(order)
        x, h = self.hidden(context)
        top = min(TOP, len(self.node))
        row, k, side = self.tree.top(target)
        odds = h @ self.node[:top].T + self.bias[:top]
        at = row * top + k
        slopes = np.zeros_like(odds)
        slopes.ravel()[at] = -side / (1 + np.exp(side * odds.ravel().take(at)))
        back = slopes @ self.node[:top]
        nodes, rows = [], []
        for k, side in self.tree.deep(target):
            n, node = len(k), self.node.take(k, axis=0)
            slope = -side / (1 + np.exp(side * (np.einsum("ij,ij->i", h[:n], node) + self.bias.take(k))))
            back[:n] += node * slope[:, None]
            nodes.append(k)
            rows.append(np.column_stack([h[:n] * slope[:, None], slope]))
        if nodes:
            sums = sums_by(np.concatenate(nodes), np.concatenate(rows), len(self.node))
            grad.node[...], grad.bias[...] = sums[:, :-1], sums[:, -1]
        grad.node[:top] += slopes.T @ h
        grad.bias[:top] += slopes.sum(axis=0)
        back *= 1 - h * h
        grad.w[...], grad.b[...] = x.T @ back, back.sum(axis=0)
        grad.embed[...] = sums_by(context.ravel(), (back @ self.w.T).reshape(-1, DIM), len(self.embed))
        grad.flat /= len(target)
        return grad


class Trainer:
    """Improves a network step by step; each parameter has a step size of its own, by its past gradients."""

    def __init__(self, net: Net):
        self.net, self.seen = net, 0
        self.sums = np.full_like(net.flat, 1e-3)
        self.size = max(STEP, net.vocab // 2)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        self.seen += len(target)
        g = self.net.gradient(context, target).flat
        g *= np.float32(np.sqrt(len(target)))
        self.sums += g * g
        g /= np.sqrt(self.sums)
        g *= np.float32(RATE)
        self.net.flat -= g


def positions(ids: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stream of all texts with "outside" around each, the places of the words in it, and the text of each."""
    gap = np.full(SIDE, outside, np.int32)
    stream = np.concatenate([gap, *[y for x in ids for y in (x.astype(np.int32), gap)]])
    at = np.flatnonzero(stream != outside)
    return stream, at, np.repeat(np.arange(len(ids)), [len(x) for x in ids])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER to the powers 0 to n - 1 at least, modulo 2^64, and their inverses."""
    have = _powers[0]
    if len(have) < n:
        size = max(n, BLOCK + (1 << 16))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))]
    return _powers[0], _powers[1]


_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space, A-Z lower-cased) of all texts in turn, and where each
    text's words start. A word's hash is a polynomial of its bytes, mixed."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]  # a blank ends each text
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    low = raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32) + np.uint8(1)
    low *= ~blank
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = (edge if blank[0] else np.append(0, edge))[0::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    power, inverse = powers(len(raw))
    return mix64(np.add.reduceat(low * power[: len(raw)], starts) * inverse.take(starts)), np.searchsorted(starts, at - at[0])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (its hash, as a signed number), n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), BLOCK):
                found = pc.value_counts(pa.array(words_in(b)[0].view(np.int64)))
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return docs.select(column(text_col).cast("string").alias("text")).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def known_words(words: int) -> int:
    """Words with an id of their own in a corpus of so many words."""
    return int(KNOWN * max(1.0, words / BASE) ** (1 / 3))


def shared_id(words: np.ndarray) -> np.ndarray:
    """Which of the HASHED shared ids words (hashes) have that have none of their own."""
    return (words.view(np.uint64) >> np.uint64(20)) % np.uint64(HASHED)


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """counts: written table. The most frequent words (then by hash) in the order of their ids, and corpus counts by id."""
    first = known_words(counts.agg(F.sum("n")).first()[0] or 0)
    top = counts.orderBy(F.col("n").desc(), "word").limit(first).toArrow()  # as many as the model has ids
    words, n = top["word"].to_numpy(), top["n"].to_numpy()
    by_id = np.zeros(first + HASHED, np.int64)
    by_id[: len(n)] = n
    shared = counts.groupBy(F.pmod(F.shiftrightunsigned("word", 20), F.lit(HASHED)).alias("k")).agg(F.sum("n").alias("n")).toArrow()  # HASHED rows at most
    by_id[first + shared["k"].to_numpy()] = shared["n"].to_numpy()
    np.subtract.at(by_id, first + shared_id(words).astype(np.int64), n)
    return words, by_id


def id_type(vocab: int) -> type:
    return np.uint16 if vocab <= 1 << 16 else np.uint32


def to_ids(docs: DataFrame, known: np.ndarray, vocab: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (unsigned, see id_type) of each row's words, row (a number of its own), shared (the hashes of its words with shared ids)."""
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    first, kind = vocab - HASHED, id_type(vocab)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own = TaskContext.get().partitionId() << 40, pa.array(known)
        for batch in batches:
            done = 0
            for b in blocks(batch.column("text"), BLOCK):
                words, starts = words_in(b)
                ids = pc.fill_null(pc.index_in(pa.array(words.view(np.int64)), own), -1).to_numpy()
                far = ids < 0
                rare = words[far]
                flat = ids.astype(kind)
                flat[far] = first + shared_id(rare)
                raw = [flat[a:e].tobytes() for a, e in zip(starts[:-1], starts[1:], strict=True)]
                upto = np.append(0, np.cumsum(far))[starts]
                shared = [rare[a:e].tobytes() for a, e in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(b)), pa.array(raw, pa.binary()), pa.array(np.arange(row, row + len(b))), pa.array(shared, pa.binary())], names=["doc_id", "ids", "row", "shared"])
                done, row = done + len(b), row + len(b)

    return rows.mapInArrow(lean(code), rows.select("doc_id", F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("row"), F.lit(b"").alias("shared")).schema)


def shares(ids: DataFrame, counts: DataFrame, by_id: np.ndarray) -> DataFrame:
    """row, share: the sum of log(n(word) / (n(id) + 1)) over a row's words with shared ids, for rows that have some.

    Words meet their counts by 64-bit hashes, each of a row once; no task holds the corpus's words.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for b in blocks(batch.column("shared"), GROUP_BYTES):
                texts = [np.frombuffer(x.as_buffer(), np.uint64) for x in b]
                rows = np.repeat(batch.column("row").slice(done, len(b)).to_numpy(), [len(x) for x in texts])
                done += len(b)
                words = np.concatenate(texts)
                if not len(words):
                    continue
                order = np.argsort(words, kind="stable")  # rows stay in order within a word
                words, rows = words[order], rows[order]
                at = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(words[at].view(np.int64)), pa.array(np.diff(np.append(at, len(words))).astype(np.int32))], names=["row", "word", "times"])

    totals = ids.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(np.log(by_id[-HASHED:] + 1.0))], "k long, total double")  # HASHED rows
    logs = counts.withColumn("k", F.pmod(F.shiftrightunsigned("word", 20), F.lit(HASHED))).join(F.broadcast(totals), "k").select("word", (F.log("n") - F.col("total")).alias("log"))
    words = ids.select("row", "shared").mapInArrow(lean(spell), "row long, word long, times int")
    return words.join(logs, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("share"))


def arrays(batches: Iterator[pa.RecordBatch], vocab: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with some size bytes of ids."""
    for batch in batches:
        done = 0
        for b in blocks(batch.column("ids"), size):
            yield batch.slice(done, len(b)), [np.frombuffer(x.as_buffer(), id_type(vocab)) for x in b]
            done += len(b)


def share_of(ids: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The rows whose positions train in a round; each row is in one round's."""
    return ids.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn)


def trainers(words: int, vocab: int, rounds: int) -> int:
    """How many models a round trains: by the positions it has, not by the partitions that hold them."""
    return max(1, words // rounds // max(TRAINER, PER_PARAMETER * length(vocab)))


def trained(ids: DataFrame, model: np.ndarray, tree: Tree, turn: int, rounds: int = ROUNDS, count: int = 1) -> DataFrame:
    """One round: count models at most, in slices: part, slice, weight (its positions), values (float32)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, part = Trainer(Net(model.copy(), tree)), TaskContext.get().partitionId()
        net, context, target = trainer.net, np.zeros((0, 2 * SIDE), np.int32), np.zeros(0, np.int32)
        for _, texts in arrays(batches, net.vocab):
            stream, at, _ = positions(texts, net.vocab)
            context, target = np.concatenate([context, stream[at[:, None] + OFFSETS]]), np.concatenate([target, stream[at]])
            whole = len(target) // trainer.size * trainer.size
            for s in range(0, whole, trainer.size):
                trainer.step(context[s : s + trainer.size], target[s : s + trainer.size])
            context, target = context[whole:], target[whole:]
        if len(target):
            trainer.step(context, target)
        if trainer.seen:
            cut = np.array_split(net.flat, SLICES)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * SLICES, pa.int64()), "slice": pa.array(range(SLICES), pa.int32()), "weight": pa.array([float(trainer.seen)] * SLICES), "values": pa.array([c.tobytes() for c in cut], pa.binary())})

    return share_of(ids, turn, rounds).select("ids").coalesce(count).mapInArrow(lean(train), "part long, slice int, weight double, values binary")


def averaged(models: DataFrame) -> np.ndarray | None:
    """The weighted mean of the models, by a reduction tree with FAN_IN models to a group. One model reaches the driver."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        weights = table["weight"].to_pylist()
        total = sum(w * np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for w, v in zip(weights, table["values"], strict=True)) / sum(weights)
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), "slice": pa.array([table["slice"][0].as_py()], pa.int32()), "weight": pa.array([sum(weights)]), "values": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    models = materialize(models, "models")
    while True:
        most = models.agg(F.max("part")).first()[0]
        if most is None:
            return None
        if most == 0:
            break
        models = materialize(models.groupBy(F.floor(F.col("part") / FAN_IN).alias("group"), "slice").applyInArrow(lambda t: add(t), models.schema), "models")
    rows = sorted(models.collect(), key=lambda r: r["slice"])
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])


def fit(ids: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Net:
    """The trained network. ids: written table of to_ids; counts: by id."""
    net = Net.initial(counts)
    count = trainers(int(counts.sum()), len(counts), rounds)
    for turn in range(rounds):
        model = averaged(trained(ids, net.flat, net.tree, turn, rounds, count))
        net = net if model is None else Net(model, net.tree)
    return net


def scored(ids: DataFrame, net: Net, share: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over words, natural), mean_log_probability, perplexity. share: what shares
    returns; without it these are the probabilities of ids."""
    kind = ids.schema["doc_id"].dataType.simpleString()
    vocab = net.vocab

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in arrays(batches, vocab):
            stream, at, owner = positions(texts, vocab)
            logs = np.zeros(len(at))
            for s in range(0, len(at), CHUNK):
                here = at[s : s + CHUNK]
                logs[s : s + CHUNK] = net.log_probabilities(stream[here[:, None] + OFFSETS], stream[here])
            total = np.bincount(owner, logs, minlength=len(texts)) if len(at) else np.zeros(len(texts))
            n = np.array([len(x) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n), pa.array(total)], names=["doc_id", "row", "n_words", "log_likelihood"])

    out = ids.select("doc_id", "ids", "row").mapInArrow(lean(score), f"doc_id {kind}, row long, n_words long, log_likelihood double")
    if share is not None:
        out = out.join(share, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("share", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_probability"), F.exp(-mean).alias("perplexity"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: the columns of scored, by a model trained on all rows of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; they are the same where their 64-bit hashes are. A null or empty text has no words, sum 0 and
    null mean and perplexity. Repeated rows train and return as often as they stand. An empty table gives no rows.
    The model depends on the order of rows in files by float rounding and by the tasks that train; scores of one
    written input agree between runs with the same partitions.
    """
    counts = materialize(word_counts(docs, text_col), "word-counts")
    known, by_id = vocabulary(counts)
    ids = materialize(to_ids(docs, known, len(by_id), id_col, text_col), "word-ids")
    share = materialize(shares(ids, counts, by_id), "word-shares")
    discard(counts)
    return scored(ids, fit(ids, by_id, rounds), share)


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
