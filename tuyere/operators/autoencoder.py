"""An autoencoder of several layers, trained by mini-batches in tasks whose parameters are averaged (C-23).

Every round is one pass: each part of the rows is gone through in mini-batches from the parameters of the round before, and gives
back what it has arrived at (with the moments of Adam), times its number of rows; Spark adds these by position. Only the sums,
whose number does not depend on the rows, reach the driver. The loss of a tenth of the rows, chosen by a hash of their id and
never trained on, decides when to stop. Rows are read in Arrow batches, so a task holds one batch at a time. Nets learn in single
precision; losses and errors are in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.functions.storage import stored
from tuyere.operators.models import _above

HIDDEN = (64, 32, 8, 32, 64)
#: Rows of a block, and of those put in random order at a time. A net learns from so many rows in a round, two times as many at
#: most; beyond PARTS nets a part has several lanes, LANES at most.
BLOCK, BATCH_ROWS, NET_ROWS, PARTS, LANES = 250, 10_000, 500_000, 24, 8


def shapes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, width]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def unpack(flat: np.ndarray, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in sizes:
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(sizes: list[tuple[int, int]], seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([random.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in sizes])


def outputs(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """What every layer gives: all but the last are cut at zero."""
    found = [x]
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k + 1 < len(layers):
            x = np.maximum(x, 0)
        found.append(x)
    return found


def loss_and_gradient(flat: np.ndarray, sizes: list[tuple[int, int]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the mean squared difference, and its gradient."""
    layers = unpack(flat, sizes)
    found = outputs(layers, x)
    off = found[-1] - x
    g, parts = off / off.size, []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(found[k].T @ g).ravel(), g.sum(0)]))
        if k:
            g = (g @ layers[k][0].T) * (found[k] > 0)
    return float((off**2).sum() / off.size / 2), np.concatenate(parts[::-1])


class Lanes:
    """Nets of the same sizes that learn side by side from rows of their own, by Adam, in arrays made once: a step of all of them is
    one product a layer. A layer's weights and, below them, its biases are one matrix over an input with a last column of ones,
    which is how they lie in the flat parameters. State: the parameters, and the moments of Adam divided by 0.1 and 0.001."""

    def __init__(self, state: np.ndarray, sizes: list[tuple[int, int]], lanes: int, batch: int, kind: type = np.float32):
        size = len(state) // 3
        self.lanes, self.batch = lanes, batch
        self.p, self.m, self.v = (np.tile(state[k * size : k * size + size].astype(kind), (lanes, 1)) for k in range(3))
        self.g, self.spare = np.empty_like(self.p), np.empty_like(self.p)
        ends = np.cumsum([0] + [(a + 1) * b for a, b in sizes])
        cut = lambda flat: [flat[:, at : at + (a + 1) * b].reshape(lanes, a + 1, b) for at, (a, b) in zip(ends, sizes, strict=False)]
        self.w, self.gw = cut(self.p), cut(self.g)
        assert all(np.shares_memory(w, self.p) and np.shares_memory(g, self.g) for w, g in zip(self.w, self.gw, strict=True))
        self.made: dict[int, tuple] = {}

    def _arrays(self, n: int) -> tuple:
        if n not in self.made:
            shapes = [(self.lanes, n, w.shape[1]) for w in self.w]
            inputs, back, signs = ([np.ones(s, self.p.dtype) for s in shapes] for _ in range(3))
            off = np.empty((self.lanes, n, self.w[-1].shape[2]), self.p.dtype)
            self.made[n] = inputs, [i[:, :, :-1] for i in inputs[1:]], back, signs, off
        return self.made[n]

    def step(self, x: np.ndarray, t: float, rate: float) -> None:
        """x: lanes, rows, columns; t: the number of this step from 1."""
        inputs, outs, back, signs, off = self._arrays(x.shape[1])
        last = len(self.w) - 1
        inputs[0][:, :, :-1] = x
        for k in range(last):
            np.matmul(inputs[k], self.w[k], out=outs[k])
            np.maximum(inputs[k + 1], 0, out=inputs[k + 1])
        np.matmul(inputs[last], self.w[last], out=off)
        off -= x
        off *= 1 / (x.shape[1] * x.shape[2])
        g = off
        for k in range(last, 0, -1):
            np.matmul(inputs[k].transpose(0, 2, 1), g, out=self.gw[k])
            np.matmul(g, self.w[k].transpose(0, 2, 1), out=back[k])
            np.sign(inputs[k], out=signs[k])
            back[k] *= signs[k]
            g = back[k][:, :, :-1]
        np.matmul(inputs[0].transpose(0, 2, 1), g, out=self.gw[0])
        self.m *= 0.9
        self.m += self.g
        self.g *= self.g
        self.v *= 0.999
        self.v += self.g
        root = float(np.sqrt(0.001 / (1 - 0.999**t)))
        np.sqrt(self.v, out=self.spare)
        self.spare += 1e-8 / root
        np.divide(self.m, self.spare, out=self.spare)
        self.spare *= float(rate * 0.1 / (1 - 0.9**t) / root)
        self.p -= self.spare

    def learn(self, rows: np.ndarray, done: float, rate: float) -> int:
        """Steps over rows, a multiple of the lanes, dealt to them in turn; tells how many."""
        dealt = rows.reshape(-1, self.lanes, rows.shape[1]).transpose(1, 0, 2)
        n = 0
        for k in range(0, dealt.shape[1], self.batch):
            n += 1
            self.step(dealt[:, k : k + self.batch], done + n, rate)
        return n


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """part, held, x: the rows (held boolean, x array<double>) in blocks of BLOCK, as bytes and as numbers of eight bytes, dealt
    evenly to so many files. They are read many times, and a block costs what a row does."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            held = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            x = np.asarray(b.column(1).flatten(), float).reshape(len(held), -1)
            at = range(0, len(held), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([v[k : k + BLOCK].tobytes() for k in at], pa.binary()) for v in (held, x)], names=["held", "x"])

    return stored(rows.mapInArrow(pack, "held binary, x binary").repartition(parts).select(F.spark_partition_id().alias("part"), "held", "x"), "autoencoder")


def train(rows: DataFrame, width: int, *, hidden: tuple[int, ...] = HIDDEN, rounds: int = 50, batch: int = 32, rate: float = 0.001, patience: int = 10, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """The parameters with the least held-out loss, and these losses by round. rows: held boolean, x array<double>.

    Rows are dealt to parts, and those of a part to its lanes; every lane has a net of its own in a round. How many there are
    follows from the number of rows, not from the machines."""
    nets = max(1, rows.count() // NET_ROWS)
    lanes = min(LANES, -(-nets // PARTS))
    rows = packed(rows, -(-nets // lanes))
    sizes = shapes(width, hidden)
    params = start(sizes, seed)
    size, state = len(params), np.concatenate([params, np.zeros(2 * len(params))])
    best, losses, steps = (np.inf, params), [], 0.0

    for r in range(rounds + 1):
        last = r == rounds

        def go(batches, state=state, steps=steps, r=r, last=last):
            import pyarrow as pa

            now = unpack(state[:size], sizes)
            held = off = 0.0
            begun: dict[int, list] = {}  # part -> its lanes, random order, rows, steps and the rows not yet learned from

            def given(part):
                net, random, n, done, few = begun.pop(part)
                if len(few):  # fewer than lanes: some lanes learn from the same row
                    done += net.learn(few[np.arange(lanes) % len(few)], steps + done, rate)
                values = np.concatenate([[n, 0, 0, n * done], n * np.concatenate([v.astype(float).mean(0) for v in (net.p, net.m, net.v)])])
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["k", "v"])

            for b in batches:
                part_of = b.column(0).to_numpy()
                for part in dict.fromkeys(part_of.tolist()):
                    for other in [p for p in begun if p != part]:
                        yield given(other)
                    mine = b.filter(pa.array(part_of == part))
                    out = np.frombuffer(b"".join(mine.column(1).to_pylist()), np.uint8).astype(bool)
                    x = np.frombuffer(b"".join(mine.column(2).to_pylist())).reshape(-1, width)
                    for k in range(0, len(x), BATCH_ROWS):
                        some, aside = x[k : k + BATCH_ROWS], out[k : k + BATCH_ROWS]
                        if aside.any():
                            held += aside.sum()
                            off += ((outputs(now, some[aside])[-1] - some[aside]) ** 2).sum() / width / 2
                        if last or aside.all():
                            continue
                        if part not in begun:
                            begun[part] = [Lanes(state, sizes, lanes, batch), np.random.default_rng([seed, r, part]), 0, 0, np.empty((0, width), np.float32)]
                        one = begun[part]
                        mixed = one[1].permutation(some[~aside].astype(np.float32))
                        one[2] += len(mixed)
                        mixed = np.concatenate([one[4], mixed])
                        even = len(mixed) // lanes * lanes
                        one[3] += one[0].learn(mixed[:even], steps + one[3], rate)
                        one[4] = mixed[even:]
            for part in list(begun):
                yield given(part)
            yield pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), pa.array([held, off])], names=["k", "v"])

        sums = {x.k: x.v for x in rows.mapInArrow(go, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # a number a parameter
        n, held = sums.get(0, 0.0), sums.get(1, 0.0)
        losses.append(sums[2] / held if held else 0.0)
        if losses[-1] < best[0] - 1e-4 * abs(best[0]) if np.isfinite(best[0]) else True:
            best, since = (losses[-1], state[:size]), 0
        else:
            since += 1
        if last or since >= patience or not n:
            break
        state = np.array([sums[k] for k in range(4, 4 + 3 * size)]) / n
        steps += sums[3] / n
    return best[1], losses


def autoencoder(df: DataFrame, columns: list[str], *, id_col: str = "id", hidden: tuple[int, ...] = HIDDEN, rounds: int = 50, batch: int = 32, rate: float = 0.001, share: float = 0.05, seed: int = 42) -> DataFrame:
    """df with error, the mean squared difference of the standardised row and what the net makes of it (null where a column is
    null or NaN), and is_outlier, the given share of largest errors."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    known = F.lit(True)
    for v in x:
        known = known & v.isNotNull() & ~F.isnan(v)
    moments = df.where(known).agg(*[f(v) for v in x for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return df.withColumn("error", F.lit(None).cast("double")).withColumn("is_outlier", F.lit(False))
    z = F.array(*[(v - F.lit(moments[2 * k])) / F.lit(moments[2 * k + 1] or 1.0) for k, v in enumerate(x)])
    rows = df.where(known).select((F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), F.lit(10)) == 0).alias("held"), z.alias("x"))
    params, _ = train(rows, len(columns), hidden=hidden, rounds=rounds, batch=batch, rate=rate, seed=seed)
    sizes = shapes(len(columns), hidden)
    mean, deviation = np.array(moments[0::2], float), np.array([s or 1.0 for s in moments[1::2]], float)

    @F.pandas_udf("double")
    def error(values: pd.DataFrame) -> pd.Series:
        rows = (values.to_numpy(float) - mean) / deviation
        given = ~np.isnan(rows).any(axis=1)
        out = np.full(len(rows), np.nan)
        out[given] = ((outputs(unpack(params, sizes), rows[given])[-1] - rows[given]) ** 2).mean(1)
        return pd.Series(out)

    scored = df.withColumn("error", F.nanvl(error(F.struct(*[v.alias(f"x{k}") for k, v in enumerate(x)])), F.lit(None).cast("double")))
    return _above(stored(scored, "autoencoder-errors"), "error", share)  # each row is scored once
