"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

The softmax has two exact levels, both with vectors. Classes: the most frequent training words are classes of their own, so
is the end of a text, and all other words share classes by their ending. The first level predicts the class of a token from
the two before it: the context vector is the sum of the two class vectors, each weighted by a vector of its place, and a
class scores by the product with its own vector plus a bias. The second predicts the item within a class of many words from
the token before: each of the ``WORDS`` next most frequent words is an item with a vector and a bias of its own, and one
item stands for the class's other words, which share it by their training counts, with one unseen word a class. So the
probabilities over all words add up to one:

    p(word | context) = p(class | context) * p(item | class, last class) [* (count + 1) / (tokens + words + 1 of the item's words)]

Training: every training text is counted, as (context, class) and (last class, item) counts merged over the corpus; the
tables have at most ``classes ** 3`` and ``classes * items`` rows, however large the corpus. Tasks train on their part of
them from the same start, and the parameters are averaged by the tokens seen after each round. Scoring: matrix products
give the normalised log-probabilities of all classes after all contexts, and of all items after all classes.

Word counts stay distributed. The most frequent ``HEAD`` words go to all tasks; the other words of each document, counted
within it, are joined to their counts.

Cases: a null text is an empty one and has one token, its end; words that training lacks count 0; without any training
text all scores come from the unseen words alone; repeated ids are rows of their own; texts are taken whole; an
empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuyere.llm.shared import LOWER, one_thread, remainder, slices, written

#: Words sent to all tasks with their counts: a bound of the broadcast, not of what is counted.
HEAD = 60_000
#: Words that are classes of their own, and classes of the others.
OWN, ENDINGS = 127, 64
CLASSES = 1 + OWN + ENDINGS
#: Words that are items of their own within the classes of many words; one item more a class is for its other words.
WORDS = 8192
#: The token of a text's end; no word holds a space.
END = " "
WIDTH, NOISE, BATCH, ROUNDS, RATE = 24, 24, 4096, 4, 0.08
ITEM_NOISE, ITEM_ROUNDS = 8, 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def ending_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word.rstrip(b".,;:!?")[-2:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """word, c of all texts, ends included. Each task counts first and sends a word once."""

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return got

        for batch in slices(batches, 500):
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
            held[END.encode()] += batch.num_rows
            if len(held) > 400_000:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """(word, count) of all words at or above the least count class that keeps them within ``most``, and the end of a text.
    Classes are sixteenths of a doubling, so only a few hundred sums and then at most ``most`` words reach the driver."""
    kind = F.floor(F.log2(F.col("c").cast("double")) * 16)
    classes = sorted(((x.k, x.n) for x in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = None, 1
    for k, more in classes:
        n += more
        if n > most:
            break
        least = k
    chosen = F.col("word") == END
    if least is not None:
        chosen = chosen | (kind >= least)
    return sorted(((x.word, x.c) for x in counts.where(chosen).collect()), key=lambda x: (-x[1], x[0]))


class Head:
    """The most frequent words: class, item (-1 in a class of its own), log10(count + 1), and whether counted."""

    def __init__(self, rows: list[tuple[str, int]], most_items: int = WORDS) -> None:
        self.most, self.n_items = most_items, most_items + ENDINGS
        self.words = [w.encode() for w, _ in rows]
        self.counts = np.array([c for _, c in rows], np.int64)

    def ready(self) -> Head:
        """Adds what a task looks up; made in the task."""
        ranked = [w for w in self.words if w != END.encode()]
        named = {w: 1 + k for k, w in enumerate(ranked[:OWN])}
        named[END.encode()] = 0
        own_items = {w: k for k, w in enumerate(ranked[OWN : OWN + self.most])}
        self.place = {w: k for k, w in enumerate(self.words)}
        self.classes = np.array([named[w] if w in named else ending_class(w) for w in self.words] or [0], np.int64)
        self.items = np.array([-1 if w in named else own_items.get(w, self.most + ending_class(w) - 1 - OWN) for w in self.words] or [-1], np.int64)
        self.item_class = np.concatenate([[ending_class(w) for w in ranked[OWN : OWN + self.most]], np.full(self.most - len(own_items), -1), np.arange(1 + OWN, CLASSES)]).astype(np.int64)
        self.logs = np.log10(np.append(self.counts, 0)[: max(1, len(self.counts))] + 1.0)
        self.end = self.place.get(END.encode(), -1)
        return self

    def of_word(self, word: bytes) -> tuple[int, int]:
        """(class, item) of any word."""
        at = self.place.get(word, -1)
        if at >= 0:
            return int(self.classes[at]), int(self.items[at])
        kind = 0 if word == END.encode() else ending_class(word)
        return kind, self.most + kind - 1 - OWN if kind else -1

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(places in the head or -1, classes, items, the words that are not in the head), the end last."""
        words = words_of(text)
        get = self.place.get
        at = np.array([get(w, -1) for w in words] + [self.end], np.int64)
        classes, items = self.classes[at], self.items[at]
        rest = []
        missing = np.flatnonzero(at < 0)
        for k in missing.tolist():
            if k == len(words):
                classes[k], items[k] = 0, -1
            else:
                rest.append(words[k])
                classes[k] = ending_class(words[k])
                items[k] = self.most + classes[k] - 1 - OWN
        return at, classes, items, rest


def contexts(classes: np.ndarray) -> np.ndarray:
    """The number of each token's context; CLASSES stands for what comes before a text."""
    before = np.concatenate([[CLASSES, CLASSES], classes])
    return before[:-2] * (CLASSES + 1) + before[1:-1]


def count_contexts(docs: DataFrame, head) -> DataFrame:
    """code, n: merged in each task, then over all. Codes are context and class in one number, or, below zero, -1 less the
    last class and the item in one number."""

    def count(batches):
        import pyarrow as pa

        known, names, counts, fresh = head.value.ready(), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        pairs = np.zeros((CLASSES + 1) * known.n_items, np.int64)

        def merged():
            got, place = np.unique(np.concatenate([names, *[x for x, _ in fresh]]), return_inverse=True)
            return got, np.bincount(place, np.concatenate([counts, *[n for _, n in fresh]])).astype(np.int64)

        for batch in slices(batches, 500):
            codes, both = [], []
            for text in batch.column("text").to_pylist():
                _, classes, items, _ = known.tokens(text)
                context = contexts(classes)
                codes.append(context * CLASSES + classes)
                inner = items >= 0
                both.append((context % (CLASSES + 1))[inner] * known.n_items + items[inner])
            fresh.append(np.unique(np.concatenate(codes), return_counts=True))
            found, n = np.unique(np.concatenate(both), return_counts=True)
            pairs[found] += n
            if sum(len(x) for x, _ in fresh) > 1_500_000:
                names, counts = merged()
                fresh = []
        names, counts = merged()
        seen = np.flatnonzero(pairs)
        names, counts = np.concatenate([-1 - seen, names]), np.concatenate([pairs[seen], counts])
        for at in range(0, len(names), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 18)]), pa.array(counts[at : at + (1 << 18)])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def initial(share: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that begin as the unigram model."""
    random = np.random.default_rng(seed)
    return {"R": random.normal(0, 0.1, (CLASSES + 1, WIDTH)), "C": np.ones((2, WIDTH)) + random.normal(0, 0.1, (2, WIDTH)), "Q": random.normal(0, 0.1, (CLASSES, WIDTH)), "b": np.log(share)}


def _add_rows(target: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(place, kind="stable")
    names, start = np.unique(place[order], return_index=True)
    target[names] += np.add.reduceat(rows[order], start, axis=0)


def train(model: dict[str, np.ndarray], code: np.ndarray, n: np.ndarray, share: np.ndarray, seed: int, rate: float) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation over (context, class) counts, by Adagrad. Every row counts as often as it
    was seen; all tokens of a batch share its noise classes."""
    random = np.random.default_rng(seed)
    model = {k: v.copy() for k, v in model.items()}
    past = {k: np.full_like(v, 1e-6) for k, v in model.items()}
    log_noise = np.log(NOISE * share)
    order = random.permutation(len(code))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        weight = n[rows] / n[rows].sum()
        context, word = np.divmod(code[rows], CLASSES)
        far, near = np.divmod(context, CLASSES + 1)
        noise = random.choice(CLASSES, NOISE, p=share)
        vector = model["C"][0] * model["R"][far] + model["C"][1] * model["R"][near]
        real = (vector * model["Q"][word]).sum(1) + model["b"][word] - log_noise[word]
        fake = vector @ model["Q"][noise].T + model["b"][noise] - log_noise[noise]
        up = weight / (1 + np.exp(np.clip(real, -30, 30)))  # d log-likelihood / d real
        down = -weight[:, None] / (1 + np.exp(-np.clip(fake, -30, 30)))
        d_vector = up[:, None] * model["Q"][word] + down @ model["Q"][noise]
        gradient = {k: np.zeros_like(v) for k, v in model.items()}
        _add_rows(gradient["Q"], word, up[:, None] * vector)
        np.add.at(gradient["Q"], noise, down.T @ vector)
        gradient["b"] = np.bincount(word, up, CLASSES) + np.bincount(noise, down.sum(0), CLASSES)
        gradient["C"] = np.stack([(d_vector * model["R"][far]).sum(0), (d_vector * model["R"][near]).sum(0)])
        _add_rows(gradient["R"], far, d_vector * model["C"][0])
        _add_rows(gradient["R"], near, d_vector * model["C"][1])
        for k, g in gradient.items():
            past[k] += g * g
            model[k] += rate * g / np.sqrt(past[k])
    return model


def initial_items(item_share: np.ndarray, seed: int = 6) -> dict[str, np.ndarray]:
    """Second-level parameters that begin as the shares of a class's items."""
    random = np.random.default_rng(seed)
    return {"S": random.normal(0, 0.1, (CLASSES + 1, WIDTH)), "P": random.normal(0, 0.1, (len(item_share), WIDTH)), "a": np.log(item_share)}


def train_items(model: dict[str, np.ndarray], code: np.ndarray, n: np.ndarray, item_share: np.ndarray, item_class: np.ndarray, seed: int, rate: float) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation over (last class, item) counts, by Adagrad. The noise of a row is drawn from
    its item's class, by the shares within it."""
    random = np.random.default_rng(seed)
    model = {k: v.copy() for k, v in model.items()}
    past = {k: np.full_like(v, 1e-6) for k, v in model.items()}
    log_noise = np.log(ITEM_NOISE * item_share)
    by_class = np.argsort(item_class, kind="stable")
    upto = np.cumsum(np.where(item_class >= 0, item_share, 0.0)[by_class])
    first = np.searchsorted(item_class[by_class], np.arange(CLASSES))
    begin = np.where(first > 0, upto[np.maximum(first, 1) - 1], 0.0)  # a class's items take the range of length 1 from here
    order = random.permutation(len(code))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        weight = n[rows] / n[rows].sum()
        last, item = np.divmod(code[rows], len(item_class))
        kind = item_class[item]
        draw = begin[kind][:, None] + random.random((len(rows), ITEM_NOISE)) * (1 - 1e-9)
        noise = by_class[np.minimum(np.searchsorted(upto, draw, side="right"), len(by_class) - 1)]
        vector = model["S"][last]
        real = (vector * model["P"][item]).sum(1) + model["a"][item] - log_noise[item]
        against = model["P"][noise]
        fake = np.einsum("bd,bkd->bk", vector, against) + model["a"][noise] - log_noise[noise]
        up = weight / (1 + np.exp(np.clip(real, -30, 30)))
        down = -weight[:, None] / (1 + np.exp(-np.clip(fake, -30, 30)))
        gradient = {k: np.zeros_like(v) for k, v in model.items()}
        _add_rows(gradient["P"], np.concatenate([item, noise.ravel()]), np.concatenate([up[:, None] * vector, (down[:, :, None] * vector[:, None, :]).reshape(-1, WIDTH)]))
        gradient["a"] = np.bincount(item, up, len(item_class)) + np.bincount(noise.ravel(), down.ravel(), len(item_class))
        _add_rows(gradient["S"], last, up[:, None] * model["P"][item] + np.einsum("bk,bkd->bd", down, against))
        for k, g in gradient.items():
            past[k] += g * g
            model[k] += rate * g / np.sqrt(past[k])
    return model


def fit(table: DataFrame, model: dict[str, np.ndarray], step, rounds: int) -> dict[str, np.ndarray]:
    """Rounds of training by all tasks on their parts of the table, averaged by tokens. Parameters have a fixed size.
    step(model, code, n, round) makes one pass."""
    shapes = {k: v.shape for k, v in model.items()}
    flat = lambda m: np.concatenate([m[k].ravel() for k in shapes])

    def whole(values: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            out[k] = values[at : at + size].reshape(shape)
            at += size
        return out

    for k in range(rounds):
        start = flat(model)

        def run(batches, k=k, start=start):
            import pyarrow as pa

            one_thread()
            parts = [(b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
            if parts:
                code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                got = flat(step(whole(start), code, n, k))
                yield pa.RecordBatch.from_arrays([pa.array([float(n.sum())]), pa.array([got.tobytes()], pa.binary())], ["n", "values"])

        got = table.mapInArrow(run, "n double, values binary").collect()
        if not got:
            break
        total = sum(x.n for x in got)
        model = whole(sum(x.n / total * np.frombuffer(x["values"]) for x in got))
    return model


def log_table(model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 p(class | context) of all contexts, normalised: a row per context."""
    far = (model["C"][0] * model["R"])[:, None, :]
    near = (model["C"][1] * model["R"])[None, :, :]
    scores = ((far + near).reshape(-1, WIDTH) @ model["Q"].T + model["b"]).astype(np.float32)
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores / np.float32(np.log(10))


def item_table(model: dict[str, np.ndarray], item_class: np.ndarray) -> np.ndarray:
    """log10 p(item | its class, last class), normalised within each class: a row per last class."""
    scores = (model["S"] @ model["P"].T + model["a"]).astype(np.float32)
    for kind in range(1 + OWN, CLASSES):
        own = np.flatnonzero(item_class == kind)
        part = scores[:, own] - scores[:, own].max(axis=1, keepdims=True)
        scores[:, own] = part - np.log(np.exp(part).sum(axis=1, keepdims=True))
    return scores / np.float32(np.log(10))


class Model:
    """What training leaves: the head, both levels' parameters, and log10 of (tokens + words + 1) of each class's other words."""

    def __init__(self, counts: DataFrame, head: Head, total: int, distinct: int) -> None:
        self.counts, self.head, self.total, self.distinct = counts, head, total, distinct
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}
        self.rest = np.zeros(head.n_items)

    def parameters(self) -> tuple:
        return self.head, self.first, self.second, self.rest


def learn(training: DataFrame, most_head: int = HEAD, most_items: int = WORDS) -> Model:
    """The model of the texts in the column text."""
    spark = training.sparkSession
    counts = written(count_words(training), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = Model(counts, Head(most_frequent(counts, most_head), most_items), int(total), int(distinct))
    head = spark.sparkContext.broadcast(model.head)  # most_head words at most
    n_items = model.head.n_items

    def sums(batches):
        import pyarrow as pa

        known = head.value.ready()
        size = CLASSES + n_items
        tokens, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in slices(batches, 1 << 16):
            found = np.array([known.of_word(x.encode()) for x in batch.column("word").to_pylist()], np.int64).reshape(-1, 2)
            c = batch.column("c").to_numpy()
            inner = found[:, 1] >= 0
            for names, n in ((found[:, 0], c), (found[inner, 1] + CLASSES, c[inner])):
                tokens += np.bincount(names, n, size).astype(np.int64)
                kinds += np.bincount(names, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(tokens), pa.array(kinds)], ["name", "tokens", "kinds"])

    sizes = counts.mapInArrow(sums, "name long, tokens long, kinds long").groupBy("name").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect()
    tokens, kinds = np.zeros(CLASSES + n_items), np.zeros(CLASSES + n_items)
    for x in sizes:
        tokens[x["name"]], kinds[x["name"]] = x.tokens, x.kinds
    share = (tokens[:CLASSES] + 1) / (tokens[:CLASSES] + 1).sum()
    item_class = Head(list(zip(map(bytes.decode, model.head.words), model.head.counts.tolist(), strict=True)), most_items).ready().item_class
    item_tokens = np.where(item_class >= 0, tokens[CLASSES:] + 1, 1.0)
    per_class = np.bincount(item_class[item_class >= 0], item_tokens[item_class >= 0], CLASSES)
    item_share = np.where(item_class >= 0, item_tokens / np.where(item_class >= 0, per_class[item_class], 1.0), 1.0)
    model.rest = np.where(np.arange(n_items) >= most_items, np.log10(tokens[CLASSES:] + kinds[CLASSES:] + 1), 0.0)

    table = written(count_contexts(training, head), "lm-contexts")
    model.first = fit(table.where("code >= 0"), initial(share), lambda m, code, n, k: train(m, code, n, share, seed=k, rate=RATE / (1 + k)), ROUNDS)
    model.second = fit(table.where("code < 0"), initial_items(item_share), lambda m, code, n, k: train_items(m, -1 - code, n, item_share, item_class, seed=k, rate=RATE / (1 + k)), ITEM_ROUNDS)
    return model


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model learns from the
    documents that are not held out."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)))
    return score_by(docs, learn(docs.where(~F.col("held_out"))))


def score_by(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of doc_id, text, held_out by a model."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.parameters())  # of a fixed size

    def per_document(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        one_thread()
        head, first, second, others = shared.value
        known = head.ready()
        logs, inner_logs = log_table(first), item_table(second, known.item_class)
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 500):
            out: dict[str, list] = {k: [] for k in ("row", "n_tokens", "known", "log_counts", "model_score", "rest", "times")}
            for text in batch.column("text").to_pylist():
                at, classes, items, rest = known.tokens(text)
                in_head = at >= 0
                log_c = np.where(in_head, known.logs[at], 0.0)
                context = contexts(classes)
                inner = items >= 0
                shares = items >= known.most  # words that share an item by their counts
                total = logs[context, classes].sum(dtype=np.float64) + inner_logs[(context % (CLASSES + 1))[inner], items[inner]].sum(dtype=np.float64)
                times = Counter(rest)
                out["row"].append(row)
                out["n_tokens"].append(len(at))
                out["known"].append(int(in_head.sum()))
                out["log_counts"].append(float(log_c.sum()))
                out["model_score"].append(float(total - others[items[shares]].sum() + log_c[shares].sum()))
                out["rest"].append(list(times))
                out["times"].append(list(times.values()))
                row += 1
            kinds = {"row": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "log_counts": pa.float64(), "model_score": pa.float64(), "rest": pa.list_(pa.binary()), "times": pa.list_(pa.int64())}
            columns = [pa.array(v, kinds[k]).cast(pa.list_(pa.string())) if k == "rest" else pa.array(v, kinds[k]) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, log_counts double, model_score double, rest array<string>, times array<long>"
    scored = written(docs.select("doc_id", "held_out", "text").mapInArrow(per_document, fields), "lm-documents")
    tail = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("row", F.col("e.rest").alias("word"), F.col("e.times").alias("times"))
    tail = tail.join(model.counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    more_log = F.coalesce("more_log", F.lit(0.0))
    return scored.drop("rest", "times").join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more_log - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))).alias("base_score"),
        (F.col("model_score") + more_log).alias("score"),
    )
