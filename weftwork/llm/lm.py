"""Language-model scores of whole documents by a gated recurrent network with a class-factored output.

Word counts of all training documents make the vocabulary: the most frequent words are outputs of the network, in
classes of neighbouring frequency; all other words fall into classes by their letters, within which a word has its
smoothed share of the counts, as has one unknown word. The network is trained by truncated backpropagation in numpy,
on all training documents, once; replicas train on their parts and are averaged after each round. Scoring carries the
state over a whole document, window by window. Words become units once, in a written table that both read.

Defined results: a null text is an empty one and has the end token alone; a null id is held out as empty text would
be; repeated rows count and are scored as often as they occur; with nothing to learn from, each token is unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Shared, append_columns, slices

#: Words that the network predicts, words in one of their classes, and classes of the other words.
HEAD, CLASS_WORDS, TAIL_CLASSES = 1024, 32, 32
#: Most frequent words that are broadcast with their counts; the counts of others come by a join.
TABLE = 200_000
#: Of those, the words from which classes are made; then all words go to the nearest class.
CLUSTERED = 32_768
#: State size, and steps of a window.
STATE, STEPS = 24, 16
#: Tokens for a replica, rounds after which they are averaged, and Adam's step.
REPLICA_TOKENS, ROUNDS, RATE = 4_000_000, 2, 8e-3
#: Streams that a replica trains on side by side: as many as leave it so many updates in a round, within these bounds.
UPDATES, LEAST_STREAMS, STREAMS = 256, 16, 512
#: Tokens that a replica holds at once, besides those of one document; replicas that are summed in one task.
CHUNK_TOKENS, SUMMED = 1 << 19, 32
#: States whose outputs are taken at once, and documents that are scored in step.
SCORE_ROWS, SCORE_DOCS = 1 << 15, 4096
#: Buckets of letter pairs that describe a word.
LETTERS = 64
#: Text whose words are looked up at once; only a longer single text takes more.
SLICE_BYTES = 12 << 20
#: Distinct words that a task counts before it hands them on.
COUNT_FLUSH = 200_000
END = b""
LOG10 = math.log(10)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about SLICE_BYTES of column text: the more at once, the fewer words are met again."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before, at = np.concatenate([[0], np.cumsum(size)]), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(before, before[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_codes(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of column text, the number of each word among them, text after text, and words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    sizes = np.diff(before[np.concatenate([[0], ends])])
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), sizes


def letter_pairs(words: list[bytes]) -> np.ndarray:
    """Unit vectors of the pairs of bytes in each word and at its edges."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    of = np.cumsum(flat == 32)[:-1] - 1
    bucket = (flat[:-1] * 263 + flat[1:] * 71) % 8191 % LETTERS
    out = np.bincount(of * LETTERS + bucket, minlength=len(words) * LETTERS)[: len(words) * LETTERS].reshape(-1, LETTERS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def letter_classes(words: list[bytes], centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(letter_pairs(words[i : i + 8192]) @ centres.T).argmax(axis=1) for i in range(0, len(words), 8192)]) if words else np.zeros(0, np.int64)


def cluster(words: list[bytes], weight: np.ndarray, k: int) -> np.ndarray:
    """Centres of the words' letter pairs, by weighted spherical k-means from evenly spaced words."""
    if not words:
        return np.zeros((1, LETTERS), np.float32)
    x = letter_pairs(words)
    centres = x[np.linspace(0, len(words) - 1, min(k, len(words))).astype(int)].copy()
    w = np.sqrt(weight)[:, None].astype(np.float32)
    for _ in range(12):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x * w)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    return centres


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over docs (text): tasks count first, so a frequent word makes few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in text_slices(batches):
            words, code, sizes = word_codes(batch)
            held.update(dict(zip(words.to_pylist(), np.bincount(code, minlength=len(words)).tolist(), strict=True)))
            held[END] += len(sizes)
            if len(held) > COUNT_FLUSH:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame) -> tuple[list[bytes], list[int]]:
    """At most TABLE words by falling count, and the end token if it was counted.

    A histogram over powers of two's 64th parts tells from which count on. If even its first part has too many words, the
    first of these by count and word are taken.
    """
    bucket = F.floor(F.log2("c") * 64).cast("int")
    n, least, first = 0, 1 << 30, None
    for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        first = r.b if first is None else first
        if n + r.n > TABLE:
            break
        n, least = n + r.n, r.b
    top = counts.where(bucket >= least) if n or first is None else counts.where(bucket == first).orderBy(F.desc("c"), "word").limit(TABLE)
    # The end token may be rarer than all these; its count is looked up, as it is in every document.
    top = top.where(F.col("word") != END).unionAll(counts.where(F.col("word") == END)).select("word", "c").toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return [words[i] for i in order], [c[i] for i in order]


class Vocabulary:
    """What scoring needs to know of words; its size is bounded by TABLE."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        if END not in words:
            words, counts = [END, *words], [0, *counts]
        self.words = words
        self.count = np.array(counts, np.int64)
        at = words.index(END)
        # The end token is always predicted.
        order = [at, *(i for i in range(len(words)) if i != at)]
        self.words, self.count = [words[i] for i in order], self.count[order]
        self.head = min(HEAD, len(words))
        self.log_count = np.log10(self.count + 1.0)
        tail = self.words[self.head :]
        self.centres = cluster(tail[:CLUSTERED], self.count[self.head : self.head + CLUSTERED], TAIL_CLASSES)
        self.tails = len(self.centres)
        self.tail_class = np.concatenate([np.full(self.head, -1, np.int64), letter_classes(tail, self.centres)])
        self.head_classes = -(-self.head // CLASS_WORDS)
        self.classes = self.head_classes + self.tails

    def finish(self, tail_n: np.ndarray, tail_v: np.ndarray) -> None:
        """Takes the counts and numbers of all words outside the head, by class."""
        self.tail_n, self.tail_log = tail_n, np.log10(tail_n + tail_v + 1.0)

    def table(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words)), strict=True))

    def units(self, index: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The network's units of distinct words, -1 being the index of a rare one: a word's own, or its class's."""
        out = np.where(index < self.head, index, self.head + self.tail_class[np.maximum(index, 0)])
        rare = np.flatnonzero(index < 0)
        out[rare] = self.head + letter_classes([words[i] for i in rare.tolist()], self.centres)
        return out


class Network:
    """A gated recurrent network over units; arrays in p are all it learns."""

    def __init__(self, v: Vocabulary) -> None:
        rng = np.random.default_rng(7)
        units = v.head + v.tails
        self.head, self.head_classes, self.classes = v.head, v.head_classes, v.classes
        head = np.maximum(v.count[: v.head], 0) + 1.0
        shares = np.concatenate([np.add.reduceat(head, np.arange(0, v.head, CLASS_WORDS)), v.tail_n + 1.0])
        words = np.full(self.head_classes * CLASS_WORDS, -1e9)
        words[: v.head] = np.log(head)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.p = {"G": small(units, 3 * STATE), "U": small(STATE, 3 * STATE), "C": small(STATE, self.classes), "c": np.log(shares / shares.sum()).astype(np.float32), "W": small(self.head_classes, STATE, CLASS_WORDS), "w": words.reshape(-1, CLASS_WORDS).astype(np.float32)}

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state from gate inputs x, with what backpropagation needs. A column is a stream, here and below."""
        s, u = STATE, self.p["U"].T @ h
        # In place, here and below, since new arrays cost as much as the arithmetic.
        zr = x[: 2 * s] + u[: 2 * s]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        z, r, un = zr[:s], zr[s:], u[2 * s :]
        n = r * un
        n += x[2 * s :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, un

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each unit y, a class of other words counting as one; gradients if asked for."""
        p = self.p
        cls = np.where(y < self.head, y // CLASS_WORDS, y - self.head + self.head_classes)
        # In the order of their classes, so that a class is one slice.
        order = np.argsort(cls.astype(np.int16), kind="stable")
        h, y, cls, rows = np.take(h, order, axis=1), y[order], cls[order], np.arange(len(y))

        def soft(a: np.ndarray, pick: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Log probabilities of the picked ones, and the gradient of their negative sum."""
            a -= a.max(axis=0)
            picked = a[pick, rows]
            e = np.exp(a, out=a)
            total = e.sum(axis=0)
            if grads is not None:
                e /= total
                e[pick, rows] -= 1
            return (picked - np.log(total)).astype(np.float64), e

        logp, d = soft(p["C"].T @ h + p["c"][:, None], cls, rows)
        dh = None
        if grads is not None:
            grads["C"], grads["c"], dh = h @ d.T, d.sum(axis=1), p["C"] @ d
            grads["W"], grads["w"] = np.zeros_like(p["W"]), np.zeros_like(p["w"])
        bounds = np.searchsorted(cls, np.arange(self.head_classes + 1)).tolist()
        for k in range(self.head_classes):
            at = slice(bounds[k], bounds[k + 1])
            if at.start == at.stop:
                continue
            more, d = soft(p["W"][k].T @ h[:, at] + p["w"][k][:, None], y[at] - k * CLASS_WORDS, rows[: at.stop - at.start])
            logp[at] += more
            if grads is not None:
                grads["W"][k], grads["w"][k] = h[:, at] @ d.T, d.sum(axis=1)
                dh[:, at] += p["W"][k] @ d
        out = np.empty_like(logp)
        out[order] = logp
        if grads is None:
            return out, None
        back = np.empty_like(dh)
        back[:, order] = dh
        return out, back

    def gradients(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Negative log probability of a window of (step, stream) units, its gradients, and the state after it.

        keep is 0 where a document begins and the state starts anew, else 1.
        """
        p, s, (steps, streams) = self.p, STATE, x.shape
        gate = p["G"][x.ravel()].T.reshape(3 * s, steps, streams)
        kept = np.empty((5, s, steps, streams), gate.dtype)
        states = np.empty((s, steps, streams), gate.dtype)
        for t in range(steps):
            was = h * keep[t]
            h, *parts = self.step(gate[:, t], was)
            for k, a in enumerate((was, *parts)):
                kept[k, :, t] = a
            states[:, t] = h
        grads: dict = {}
        logp, dout = self.output(states.reshape(s, -1), y.ravel(), grads)
        dout = dout.reshape(s, steps, streams)
        was, z, r, n, un = kept
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (was - n) * z * (1 - z), un * r * (1 - r)
        g, dns = np.empty_like(gate), np.empty_like(states)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            d = dh
            d += dout[:, t]
            dn = np.multiply(d, to_n[:, t], out=dns[:, t])
            np.multiply(d, to_z[:, t], out=g[:s, t])
            np.multiply(dn, to_r[:, t], out=g[s : 2 * s, t])
            np.multiply(dn, r[:, t], out=g[2 * s :, t])
            d *= z[:, t]
            dh = p["U"] @ g[:, t]
            dh += d
            dh *= keep[t]
        grads["U"] = was.reshape(s, -1) @ g.reshape(3 * s, -1).T
        # The input of the candidate state is not gated.
        g[2 * s :] = dns
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        unit = x.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        grads["G"] = np.zeros_like(p["G"])
        grads["G"][unit[first]] = np.add.reduceat(np.ascontiguousarray(g.reshape(3 * s, -1).T)[order], first, axis=0)
        return -float(logp.sum()), grads, h

    def train(self, docs: Iterator[np.ndarray], streams: int) -> int:
        """One pass of truncated backpropagation over documents as they come; returns the number of tokens.

        The state goes on between windows and starts anew with a document, and with a chunk. What does not fill all
        streams of a chunk goes to the next.
        """
        moments = [{k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)]
        count = total = held = 0
        chunk: list[np.ndarray] = []
        rest = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool))

        def arrays() -> tuple[np.ndarray, ...]:
            y = np.concatenate(chunk) if chunk else np.zeros(0, np.int64)
            x = np.concatenate([np.zeros(1, y.dtype), y])[: len(y)]
            fresh = np.zeros(len(y), bool)
            if chunk:
                fresh[np.cumsum([0, *map(len, chunk[:-1])])] = True
            x[fresh] = 0
            return tuple(np.concatenate(z) for z in zip(rest, (x, y, fresh), strict=True))

        for doc in docs:
            chunk.append(doc)
            held += len(doc)
            total += len(doc)
            if held >= CHUNK_TOKENS:
                x, y, fresh = arrays()
                n = len(y) // streams * streams
                count = self._windows(x[:n], y[:n], fresh[:n], streams, moments, count)
                rest, chunk, held = (x[n:], y[n:], fresh[n:]), [], 0
        x, y, fresh = arrays()
        while len(y):
            streams = max(1, min(streams, len(y) // STEPS))
            n = len(y) // streams * streams
            count = self._windows(x[:n], y[:n], fresh[:n], streams, moments, count)
            x, y, fresh = x[n:], y[n:], fresh[n:]
        return total

    def _windows(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, streams: int, moments: list[dict], count: int) -> int:
        """Trains on tokens that fill all streams; returns the number of steps so far."""
        n = len(y) // streams
        x, y, fresh = (a.reshape(streams, n).T for a in (x, y, fresh))
        m, v = moments
        spare = {k: np.empty_like(a) for k, a in self.p.items()}
        h = np.zeros((STATE, streams), np.float32)
        for at in range(0, n, STEPS):
            ys, keep = y[at : at + STEPS], (~fresh[at : at + STEPS]).astype(np.float32)
            _, grads, h = self.gradients(x[at : at + STEPS], ys, keep, h)
            count += 1
            rate = RATE / (1 - 0.9**count)
            for k, g in grads.items():
                g /= ys.size
                by = np.subtract(g, m[k], out=spare[k])
                by *= np.float32(0.1)
                m[k] += by
                np.multiply(g, g, out=by)
                by -= v[k]
                by *= np.float32(0.001)
                v[k] += by
                np.divide(v[k], np.float32(1 - 0.999**count), out=by)
                np.sqrt(by, out=by)
                by += np.float32(1e-6)
                np.multiply(m[k], np.float32(rate), out=g)
                g /= by
                self.p[k] -= g
        return count

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of the units of each document, all documents in step."""
        out = np.zeros(len(docs))
        by = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        sizes = np.array([len(docs[i]) for i in by])
        flat, start = np.concatenate([docs[i] for i in by]), np.cumsum(sizes) - sizes
        h, held, n = np.zeros((STATE, len(docs)), np.float32), [], 0

        def flush() -> None:
            states, ys, of = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            out[:] += np.bincount(of, self.output(states, ys)[0], len(docs))

        for at in range(0, int(sizes[0]), STEPS):
            k = int((sizes > at).sum())
            left = sizes[:k] - at
            steps = min(STEPS, int(left[0]))
            ys = flat[np.minimum(start[:k] + at + np.arange(steps)[:, None], len(flat) - 1)]
            before = np.concatenate([(np.zeros(k, ys.dtype) if at == 0 else flat[start[:k] + at - 1])[None], ys[:-1]])
            # So many documents at once that their states stay small; outputs wait until there are enough.
            width = max(1, SCORE_ROWS // steps)
            new = np.empty((STATE, k), np.float32)
            for i in range(0, k, width):
                some = slice(i, min(k, i + width))
                gate = self.p["G"][before[:, some].ravel()].T.reshape(3 * STATE, steps, -1)
                states, now = np.empty((STATE, *gate.shape[1:]), np.float32), h[:, some]
                for t in range(steps):
                    now = states[:, t] = self.step(gate[:, t], now)[0]
                new[:, some] = now
                ok = np.flatnonzero(np.arange(steps)[:, None] < left[some])
                held.append((np.take(states.reshape(STATE, -1), ok, axis=1), ys[:, some].ravel()[ok], ok % gate.shape[2] + i))
                n += len(ok)
                if n >= SCORE_ROWS:
                    flush()
                    held, n = [], 0
            h = new
        if held:
            flush()
        result = np.empty(len(docs))
        result[by] = out / LOG10
        return result


def _tail_totals(counts: DataFrame, vocabulary, tails: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words outside the head by class, over all counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        head = set(v.words[: v.head])
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            keep = [i for i, w in enumerate(words) if w not in head]
            cls = letter_classes([words[i] for i in keep], v.centres)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.tails)), pa.array(np.bincount(cls, n[keep], v.tails).astype(np.int64)), pa.array(np.bincount(cls, minlength=v.tails))], names=["cls", "n", "v"])

    n, words = np.zeros(tails), np.zeros(tails)
    for r in counts.mapInArrow(run, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.cls], words[r.cls] = r.n, r.v
    return n, words


def _trained(data: DataFrame, vocabulary, size: int) -> Network:
    """The network after rounds of replicas on their parts of data (key, units), which tasks and then the driver average.

    A row's place in the written table deals it out, so copies of a text spread over all replicas and rounds.
    """
    spark = data.sparkSession
    v = vocabulary.value
    replicas = size // REPLICA_TOKENS + 1
    streams = min(STREAMS, max(LEAST_STREAMS, size // (replicas * ROUNDS * STEPS * UPDATES)))
    scratch = Scratch(spark, "lm-replicas")
    net = Network(v)
    for turn in range(ROUNDS):
        sent = Shared(spark, net)

        def replica(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            net = sent.value
            net.p = {k: a.copy() for k, a in net.p.items()}
            n = net.train((np.frombuffer(u, np.int16).astype(np.int64) for b in batches for some in slices([b]) for u in some.column(0).to_pylist()), streams)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(net.p)), pa.array([(n * a.astype(np.float64)).tobytes() for a in net.p.values()], pa.binary()), pa.array([n] * len(net.p))], names=["name", "value", "n"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for b in batches:
                for i, k in enumerate(b.column(0).to_pylist()):
                    value, n = sums.get(k, (0.0, 0))
                    sums[k] = value + np.frombuffer(b.column(1)[i].as_buffer(), np.float64), n + b.column(2)[i].as_py()
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([a.tobytes() for a, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()])], names=["name", "value", "n"])

        sums, weight = {k: np.zeros(a.shape) for k, a in net.p.items()}, Counter()
        part = data.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(ROUNDS)) == turn).select("units", "key")
        # Written first, since reading partition by partition would train the replicas one after another.
        # Sorted, since the order in which blocks arrive would else be that of training.
        made, left = scratch.write(part.repartition(replicas, F.xxhash64(F.lit(6), "key")).sortWithinPartitions("key").select("units").mapInArrow(replica, "name string, value binary, n long")), replicas
        while left > SUMMED:
            left = -(-left // SUMMED)
            made = scratch.write(made.repartition(left).mapInArrow(summed, "name string, value binary, n long"))
        for r in made.toLocalIterator():
            sums[r.name] += np.frombuffer(r.value, np.float64).reshape(sums[r.name].shape)
            weight[r.name] += r.n
        if weight:
            net.p = {k: (a / weight[k]).astype(np.float32) for k, a in sums.items()}
    return net


def score_documents(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; learns where held_out is false."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = scratch.write(count_words(training))
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    v = Vocabulary(*most_frequent(counts))
    v.finish(*_tail_totals(counts, Shared(spark, v), v.tails))
    vocabulary = Shared(spark, v)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        table = v.table()
        for batch in text_slices(batches):
            dictionary, code, sizes = word_codes(batch)
            words = dictionary.to_pylist()
            index = np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))
            # The end token comes last here; it has number 0 in the vocabulary.
            unit, index = np.append(v.units(index, words), 0), np.append(index, 0)
            known, tail = index >= 0, unit >= v.head
            log_count = np.where(known, v.log_count[index], 0)
            # A word of a class has its share there; what a rare word's count adds comes by the join.
            inside = np.where(tail, log_count - v.tail_log[np.maximum(unit - v.head, 0)], 0)
            ends = np.cumsum(sizes + 1)
            starts = ends - sizes - 1
            full = np.full(int(ends[-1]), len(words))
            full[np.delete(np.arange(len(full)), ends - 1)] = code
            sums = lambda of, full=full, starts=starts: np.add.reduceat(of[full], starts)
            at = np.flatnonzero(~known[full])
            pair, tf = np.unique(np.searchsorted(ends, at, "right") * (len(words) + 1) + full[at], return_counts=True)
            first = np.searchsorted(pair, np.arange(len(sizes) + 1) * (len(words) + 1))
            rare = pa.StructArray.from_arrays([dictionary.take(pa.array(pair % (len(words) + 1))), pa.array(tf, pa.int64())], names=["word", "tf"])
            units = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * np.append(0, ends)).astype(np.int32)), pa.py_buffer(unit[full].astype(np.int16))])
            found = sums((known & (v.count[index] > 0)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes + 1), pa.array(found), pa.array(sums(log_count)), pa.array(sums(inside)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), rare), units], names=["id", "held_out", "n_tokens", "n_known", "base", "inside", "rare", "units"])

    made = docs.select("id", "held_out", "text").mapInArrow(units, f"id {dict(docs.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, base double, inside double, rare array<struct<word:binary,tf:long>>, units binary")
    made = scratch.write(made.withColumn("key", F.monotonically_increasing_id()))
    net = Shared(spark, _trained(made.where(~F.col("held_out")), vocabulary, n))

    def make():
        network = net.value

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(network.score([np.frombuffer(u, np.int16).astype(np.int64) for u in batch.column(batch.schema.get_field_index("units")).to_pylist()]))]

        return run

    scored = append_columns(made.drop("rare"), [T.StructField("model", T.DoubleType())], make, SCORE_DOCS)
    rare = made.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.tf").join(counts, "word")
    more = rare.groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("found"))
    out = scored.drop("units").join(more, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(math.log10(n + distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("inside") + more).alias("score"),
    )
