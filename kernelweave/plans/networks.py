"""Neural inference: convolution and pooling as neighbour joins, recurrences as one vectorised map a sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.functions import precision
from kernelweave.operators import stats
from kernelweave.session import prepare


def convolve(maps: DataFrame, weights: list[list[list[list[float]]]], bias: list[float], size: tuple[int, int], flip: bool = True, q: int | None = None) -> DataFrame:
    """img, ch, i, j, v: valid convolution of maps (img, ch, i, j, v); weights[out][in][a][b], bound by the model.

    Each input cell sends its products to the output cells it touches, and one aggregate adds them to the bias: one
    shuffle with partial sums. ``flip`` walks the kernel backwards (true convolution). With ``q`` values are Q-format
    integers: products and bias are summed wide, shifted once and saturated to 16 bits.
    """
    n_out, n_in, fs = len(weights), len(weights[0]), len(weights[0][0])
    taps = [(o, c, a, b, weights[o][c][fs - 1 - a if flip else a][fs - 1 - b if flip else b]) for o in range(n_out) for c in range(n_in) for a in range(fs) for b in range(fs)]
    kind = "long" if q is not None else "double"
    table = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(c).alias("c"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).cast(kind).alias("w")) for o, c, a, b, w in taps))
    sent = maps.withColumn("t", F.explode(F.filter(table, lambda t: t["c"] == F.col("ch"))))
    sent = sent.select("img", F.col("t.o").alias("ch"), (F.col("i") - F.col("t.a")).alias("i"), (F.col("j") - F.col("t.b")).alias("j"), (F.col("v") * F.col("t.w")).alias("p"))
    h, w = size[0] - fs + 1, size[1] - fs + 1
    total = sent.filter(F.col("i").between(0, h - 1) & F.col("j").between(0, w - 1)).groupBy("img", "ch", "i", "j").agg(F.sum("p").alias("s"))
    start = F.element_at(F.array(*(F.lit(b).cast(kind) for b in bias)), F.col("ch") + 1)
    v = precision.saturate(F.shiftright(F.col("s") + F.shiftleft(start, q), q)) if q is not None else F.col("s") + start
    return total.select("img", "ch", "i", "j", v.alias("v"))


def pool(maps: DataFrame, size: int) -> DataFrame:
    """Non-overlapping maximum."""
    return maps.groupBy("img", "ch", F.expr(f"i div {size}").alias("i"), F.expr(f"j div {size}").alias("j")).agg(F.max("v").alias("v"))


def activate(maps: DataFrame, f) -> DataFrame:
    return maps.withColumn("v", f(F.col("v")))


def dense(inputs: DataFrame, weights: list[list[float]], bias: list[float], q: int | None = None) -> DataFrame:
    """img, unit, v of inputs (img, k, v): bias, multiply and add, and for Q formats shift and saturate, in this order."""
    kind = "long" if q is not None else "double"
    w = F.array(*(F.array(*(F.lit(x).cast(kind) for x in row)) for row in weights))
    each = inputs.select("img", "k", "v", F.posexplode(w).alias("unit", "row")).select("img", "unit", (F.col("v") * F.element_at("row", F.col("k").cast("int") + 1)).alias("p"))
    start = F.element_at(F.array(*(F.lit(b).cast(kind) for b in bias)), F.col("unit") + 1)
    total = each.groupBy("img", "unit").agg(F.sum("p").alias("s"))
    v = precision.saturate(F.shiftright(F.col("s") + F.shiftleft(start, q), q)) if q is not None else F.col("s") + start
    return total.select("img", "unit", v.alias("v"))


def flat(maps: DataFrame, size: tuple[int, int]) -> DataFrame:
    """img, k, v: maps as one row-major vector an image."""
    return maps.select("img", (F.col("ch") * size[0] * size[1] + F.col("i") * size[1] + F.col("j")).alias("k"), "v")


def standardise(images: DataFrame, column: str = "pixels") -> Column:
    """(x - mean) / max(std, 1 / sqrt(n)) of an array column."""
    n, x = F.size(column).cast("double"), F.col(column)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n
    std = F.greatest(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 1 / F.sqrt(n))
    return F.transform(x, lambda v: (v - mean) / std)


def crop(pixels: DataFrame, low: int, high: int) -> DataFrame:
    """Centre cut of (img, h, w, c, v), moved to the origin."""
    inside = F.col("h").between(low, high - 1) & F.col("w").between(low, high - 1)
    return pixels.filter(inside).select("img", (F.col("h") - low).alias("h"), (F.col("w") - low).alias("w"), "c", "v")


def _same(n: int, size: int, stride: int) -> tuple[int, int, int]:
    """Outputs of a window walked over n places so that every stride has one, and what is added before and after."""
    out = -(-n // stride)
    add = max((out - 1) * stride + size - n, 0)
    return out, add // 2, add - add // 2


def _windows(x: np.ndarray, size: int, stride: int, fill: float) -> np.ndarray:
    """(images, rows, columns, channels, size, size) of maps (images, rows, columns, channels) with edges filled."""
    (h, t, b), (w, l, r) = (_same(n, size, stride) for n in x.shape[1:3])  # noqa: E741
    padded = np.pad(x, ((0, 0), (t, b), (l, r), (0, 0)), constant_values=fill)
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size), (1, 2))[:, ::stride, ::stride][:, :h, :w]


def layer_conv(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Every place has an output; weights (rows, columns, inputs, outputs) as they lie over the map. One matrix product."""
    size, _, n_in, n_out = weights.shape
    at = _windows(x, size, 1, 0.0)
    return at.reshape(*at.shape[:3], -1) @ weights.transpose(2, 0, 1, 3).reshape(n_in * size * size, n_out) + bias


def layer_pool(x: np.ndarray, size: int = 3, stride: int = 2) -> np.ndarray:
    """Largest value of windows that may overlap and reach beyond the edge."""
    return _windows(x, size, stride, -np.inf).max((4, 5))


def layer_normalise(x: np.ndarray, radius: int = 4, bias: float = 1.0, alpha: float = 0.001 / 9, beta: float = 0.75) -> np.ndarray:
    """x / (bias + alpha * sum of squares of the channels within ``radius``) ^ beta."""
    total = np.concatenate((np.zeros((*x.shape[:3], 1)), np.cumsum(x * x, 3)), 3)
    c = np.arange(x.shape[3])
    near = total[..., np.minimum(c + radius + 1, x.shape[3])] - total[..., np.maximum(c - radius, 0)]
    return x / (bias + alpha * near) ** beta


def layer_dense(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1) @ weights + bias


#: layers by name; ``flatten`` isn't needed, dense layers take maps row by row with channels last
LAYERS = {"conv": layer_conv, "pool": layer_pool, "normalise": layer_normalise, "dense": layer_dense, "relu": lambda x: np.maximum(x, 0.0)}


def image_net(images: DataFrame, shape: tuple[int, int, int], layers: list[tuple], block: int = 64) -> DataFrame:
    """img, scores of images (img, pixels in height, width, channel order) through ``layers``: (name, arguments...) of LAYERS.

    A map without a shuffle: images go through all layers ``block`` at a time, each a matrix product or a window
    operation over arrays, so a task holds the maps of one block. The model is broadcast. Null pixels or pixels of another
    size give null scores.
    """
    spark = prepare(images.sparkSession)
    held = spark.sparkContext.broadcast(layers)
    n = int(np.prod(shape))

    def run(batches):
        for b in batches:
            ids, rows = b.column(0), b.column(1).to_pylist()
            out: list = [None] * len(rows)
            good = [k for k, v in enumerate(rows) if v is not None and len(v) == n and None not in v]
            for s in range(0, len(good), block):
                own = good[s : s + block]
                x = np.array([rows[k] for k in own], float).reshape(-1, *shape)
                for name, *arguments in held.value:
                    x = LAYERS[name](x, *arguments)
                for k, v in zip(own, x.reshape(len(own), -1).tolist()):
                    out[k] = v
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float64()))], names=["img", "scores"])

    return images.select("img", "pixels").mapInArrow(run, f"img {images.schema['img'].dataType.simpleString()}, scores array<double>")


def distort(images: DataFrame, shape: tuple[int, int, int], cut: int, seed: int = 0, brightness: float = 63.0, contrast: tuple[float, float] = (0.2, 1.8), standard: bool = True) -> DataFrame:
    """img, pixels: a random part of ``cut`` x ``cut``, mirrored or not, with brightness and contrast changed, then standardised.

    What is drawn follows from the seed and the image's id by hashes, so a row gives the same picture in every run. The
    contrast is changed around each channel's mean. Null pixels stay null; repeated rows are alike.
    """
    prepare(images.sparkSession)
    h, w, _ = shape
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "img"), F.lit(1 << 52)) / float(1 << 52)).alias(f"u{k}")
    rows = images.select("img", "pixels", *(draw(k) for k in range(5)))

    def run(batches):
        for b in batches:
            u = np.array([b.column(2 + k).to_numpy() for k in range(5)]) if b.num_rows else np.zeros((5, 0))
            out = []
            for k, v in enumerate(b.column(1).to_pylist()):
                if v is None:
                    out.append(None)
                    continue
                top, left = int(u[0, k] * (h - cut + 1)), int(u[1, k] * (w - cut + 1))
                x = np.array(v, float).reshape(shape)[top : top + cut, left : left + cut]
                x = x[:, ::-1] if u[2, k] < 0.5 else x
                x = x + (2 * u[3, k] - 1) * brightness
                mean = x.mean((0, 1), keepdims=True)
                x = (x - mean) * (contrast[0] + u[4, k] * (contrast[1] - contrast[0])) + mean
                if standard:
                    x = (x - x.mean()) / max(x.std(), 1 / np.sqrt(x.size))
                out.append(x.ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["img", "pixels"])

    return rows.mapInArrow(run, f"img {images.schema['img'].dataType.simpleString()}, pixels array<double>")


def mirror(columns: DataFrame) -> DataFrame:
    """(img, col, px) with the column order of each image reversed."""
    last = F.max("col").over(Window.partitionBy("img"))
    return columns.withColumn("col", last - F.col("col"))


def recurrent(sequences: DataFrame, weights: dict[str, np.ndarray], peephole: bool = True) -> DataFrame:
    """img, col, h of sequences (img, col, px): a forward LSTM pass with peepholes; a group is one sequence.

    weights: w_x (4, cells, inputs), w_h (4, cells, cells), bias (4, cells), peep (3, cells); gates in the order input,
    forget, output, cell. Steps depend on each other, so a sequence is one task's work and sequences are what spreads.
    """
    prepare(sequences.sparkSession)
    sig = lambda z: 1 / (1 + np.exp(-z))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        cells = weights["bias"].shape[1]
        h, c, out = np.zeros(cells), np.zeros(cells), []
        for px in pdf.px:
            z = weights["w_x"] @ np.asarray(px, float) + weights["w_h"] @ h + weights["bias"]
            peep = weights["peep"] if peephole else np.zeros((3, cells))
            i, f = sig(z[0] + peep[0] * c), sig(z[1] + peep[1] * c)
            c = f * c + i * np.tanh(z[3])
            h = sig(z[2] + peep[2] * c) * np.tanh(c)
            out.append(h.copy())
        return pd.DataFrame({"img": pdf.img.to_numpy(), "col": pdf.col.to_numpy(), "h": out})

    kind = sequences.schema["img"].dataType.simpleString()
    return sequences.select("img", F.col("col").cast("long").alias("col"), "px").groupBy("img").applyInPandas(run, f"img {kind}, col bigint, h array<double>")


def bidirectional(sequences: DataFrame, forward: dict, backward: dict) -> DataFrame:
    """img, col, h: outputs of both directions side by side; column ``col`` meets ``n - 1 - col`` of the mirrored pass."""
    last = F.max("col").over(Window.partitionBy("img"))
    back = recurrent(mirror(sequences), backward).withColumn("col", last - F.col("col")).select("img", "col", F.col("h").alias("b"))
    return recurrent(sequences, forward).join(back, ["img", "col"]).select("img", "col", F.concat("h", "b").alias("h"))


def class_scores(hidden: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """img, col, class, p: softmax over classes of h, one projection and one window of the classes of a column."""
    w = F.array(*(F.struct(F.array(*map(F.lit, map(float, r))).alias("w"), F.lit(float(b)).alias("b")) for r, b in zip(weights, bias)))
    each = hidden.select("img", "col", "h", F.posexplode(w).alias("class", "m"))
    z = F.exp(F.col("m.b") + F.aggregate(F.zip_with("m.w", "h", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return each.select("img", "col", "class", z.alias("z")).withColumn("p", F.col("z") / F.sum("z").over(Window.partitionBy("img", "col"))).drop("z")


def decode(scores: DataFrame, threshold: float = 0.7, blank: int = 0) -> DataFrame:
    """img, island, col, label: within each run of columns whose blank probability is below ``threshold``, the best label
    of its strongest column (smaller column and label on ties). The column after the last counts as no boundary."""
    best = stats.arg_max(scores.filter(F.col("class") != blank), ["img", "col"], "p", "class")
    inside = scores.filter(F.col("class") == blank).select("img", "col", (F.col("p") < threshold).alias("open"))
    runs = stats.islands(inside, ["img"], ["col"], F.col("open")).filter("open").join(best, ["img", "col"])
    top = F.min(F.struct((-F.col("p")).alias("n"), F.col("col"), F.col("class")))
    return runs.groupBy("img", "island").agg(top.alias("t")).select("img", "island", "t.col", F.col("t.class").alias("label"))


def text_of(decoded: DataFrame, alphabet: DataFrame) -> DataFrame:
    """img, text: the symbols of decoded labels in order; the alphabet (label, symbol) is a small table."""
    return decoded.join(alphabet, "label").groupBy("img").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), "").alias("text"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n, word_id: ids from 0 by count, most frequent first, then by word.

    Numbered by a sort over all tasks, so words of one count, often half of all, are no task's alone. Null is a word.
    """
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return stats.numbered(counts, F.desc("n"), "word", name="word_id")


def batches(stream: DataFrame, size: int, steps: int) -> DataFrame:
    """batch, row, step, x, y of a token stream (pos, word_id): the stream is cut into ``size`` rows, each row into
    windows of ``steps``; y is the next token. Tokens beyond size * (n div size) are left out."""
    n = F.broadcast(stream.agg((F.expr(f"count(*) div {size}")).alias("len")))  # one row
    at = stream.crossJoin(n).filter(F.col("pos") < F.col("len") * size)
    at = at.select(F.expr("pos div len").alias("row"), (F.col("pos") % F.col("len")).alias("c"), "word_id", "len")
    nxt = at.select("row", (F.col("c") - 1).alias("c"), F.col("word_id").alias("y"))
    both = at.withColumnRenamed("word_id", "x").join(nxt, ["row", "c"]).filter(F.col("c") < F.expr(f"((len - 1) div {steps}) * {steps}"))
    return both.select(F.expr(f"c div {steps}").alias("batch"), "row", (F.col("c") % steps).alias("step"), "x", "y")


def lstm_losses(windows: DataFrame, embedding: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], softmax: np.ndarray, bias: np.ndarray, forget_bias: float = 0.0) -> DataFrame:
    """batch, row, step, y, loss (minus the log of the probability of y) of windows (batch, row, step, x, y) as ``batches``
    makes them, by a stack of LSTM layers whose state goes on from one window of a row to the next.

    A layer is (kernel, bias): the kernel is (inputs + cells, 4 cells) with gates in the order input, new value, forget,
    output. Rows are dealt over tasks; a task takes all its rows through a step together and holds their states, two
    vectors a layer and row, and nothing of the past. The model is broadcast: its size is that of its vocabulary. An x
    that is null or no word is a vector of zeros; such a y has a null loss. A row begins with a state of zeros.
    """
    spark = prepare(windows.sparkSession)
    held = spark.sparkContext.broadcast((embedding, layers, softmax, bias))

    def run(chunks):
        embedding, layers, softmax, bias = held.value
        cells = [len(b) // 4 for _, b in layers]
        index: dict = {}
        h, c = ([np.zeros((0, n)) for n in cells] for _ in range(2))
        for chunk in chunks:
            batch, row, step, x, y = (chunk.column(k) for k in range(5))
            x, y = (v.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for v in (x, y))
            at = np.array([index.setdefault(r, len(index)) for r in row.to_pylist()], np.int64)
            if len(index) > len(h[0]):
                for s in (h, c):
                    for k, n in enumerate(cells):
                        s[k] = np.vstack((s[k], np.zeros((max(len(index), 2 * len(s[k])) - len(s[k]), n))))
            key = np.stack((batch.to_numpy(), step.to_numpy()))
            cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(x)])) if len(x) else np.zeros(1, int)
            loss = np.full(len(x), np.nan)
            for s, e in zip(cut, cut[1:]):  # the rows of one step
                own, word, want = at[s:e], x[s:e], y[s:e]
                known = (word >= 0) & (word < len(embedding))
                v = np.where(known[:, None], embedding[np.where(known, word, 0)], 0.0)
                for k, (kernel, b) in enumerate(layers):
                    i, j, f, o = np.split(np.hstack((v, h[k][own])) @ kernel + b, 4, 1)
                    c[k][own] = c[k][own] * _sigmoid(f + forget_bias) + _sigmoid(i) * np.tanh(j)
                    h[k][own] = v = np.tanh(c[k][own]) * _sigmoid(o)
                for p in range(0, e - s, 256):  # logits of some rows at a time
                    z, t = v[p : p + 256] @ softmax + bias, want[p : p + 256]
                    top = z.max(1)
                    good = (t >= 0) & (t < z.shape[1])
                    value = top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(t)), np.where(good, t, 0)]
                    loss[s + p : s + p + len(t)] = np.where(good, value, np.nan)
            yield pa.RecordBatch.from_arrays([batch, row, step, chunk.column(4), pa.array(loss, from_pandas=True)], names=["batch", "row", "step", "y", "loss"])

    cols = [F.col(k).cast("long").alias(k) for k in ("batch", "row", "step", "x", "y")]
    return windows.select(*cols).repartition("row").sortWithinPartitions("batch", "step", "row").mapInArrow(run, "batch long, row long, step long, y long, loss double")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def perplexity(losses: DataFrame, cost: str, steps: str) -> DataFrame:
    return losses.agg(F.exp(F.sum(cost) / F.sum(steps)).alias("perplexity"))
