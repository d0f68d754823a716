"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each looked up in a learned embedding. Learned byte
filters span ``WIDTH`` bytes and move on by ``STEP``; their rectified responses
are averaged over cells of 64 bytes, beside the share of bytes that equal the
byte 1 to ``LAGS`` back (which shows words that repeat, whatever they are). A
chunk is two neighbouring cells and overlaps the next by half, so chunks cover
the whole document, however long. Learned chunk filters weigh the channels of
both cells; each one's response is rectified and max-pooled over all chunks, and
a logistic unit combines the maxima into one probability. All weights are
learned together by gradient descent on a bounded sample of labelled rows.

Texts are laid out one after the other in packs. A long text is cut into pieces
that share a cell, so no chunk is lost and memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineaframe.storage import forget, keep, ship

CELL = 64
LAGS = 24
EMBED = 8
WIDTH = 6
STEP = 2
BYTE_FILTERS = 16
CHANNELS = BYTE_FILTERS + LAGS
FILTERS = 12
#: Most labelled rows of each class that training reads, whole texts chosen by a hash of the id. Scoring has no bound.
TRAIN_ROWS = 1000
#: Steps of training, and texts of a step.
STEPS = 80
BATCH = 100
RATE = 0.02
#: Cells of a piece of a long text, and of a pack.
PIECE = 512
PACK = 1024
#: Score from which a text counts as good.
THRESHOLD = 0.7
#: What stands for no byte: before a text, and after it to the end of its last cell.
_PAD = 256


@dataclass
class Pack:
    """Pieces in a row: ``codes`` of all cells, ``first`` cell and number of ``cells`` of each, and the text it is of.

    The cell before the first of a piece holds what precedes it.
    """

    codes: np.ndarray
    first: np.ndarray
    cells: np.ndarray
    owner: np.ndarray


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the pieces of a text, each after the cell before it; the last cell of one is the first of the next."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    cells = max(2, -(-len(data) // CELL))  # a lone cell is a chunk with an empty second half
    codes = np.full((cells + 1) * CELL, _PAD, np.uint16)
    codes[CELL : CELL + len(data)] = data
    for lo in range(0, cells - 1, PIECE - 1):
        yield codes[lo * CELL : (lo + 1 + PIECE) * CELL]


def packs(texts: Iterable[str | None]) -> Iterator[Pack]:
    held: list[tuple[int, np.ndarray]] = []
    total = 0

    def packed() -> Pack:
        sizes = np.array([len(c) // CELL for _, c in held])
        return Pack(np.concatenate([c for _, c in held]), np.cumsum(sizes) - sizes + 1, sizes - 1, np.array([o for o, _ in held]))

    for i, text in enumerate(texts):
        for codes in _pieces(text):
            if held and total + len(codes) > PACK * CELL:
                yield packed()
                held, total = [], 0
            held.append((i, codes))
            total += len(codes)
    if held:
        yield packed()


def _repeats(codes: np.ndarray) -> np.ndarray:
    """Share of the bytes of each cell that equal the byte 1, 2, ... ``LAGS`` back."""
    cells = len(codes) // CELL
    out = np.empty((cells, LAGS), np.float32)
    real, same = codes != _PAD, np.zeros(len(codes), bool)
    for lag in range(1, LAGS + 1):
        np.equal(codes[lag:], codes[:-lag], out=same[lag:])
        same &= real
        eighths = same.view(np.uint64).reshape(cells, 8).sum(axis=1, dtype=np.uint64)  # counts of 8 at most in each byte
        out[:, lag - 1] = eighths.view(np.uint8).reshape(cells, 8).sum(axis=1)
    return out / CELL


@dataclass
class Network:
    """``embed``, ``bytewise``, ``offset``: the byte filters; ``left``, ``right``, ``shift``: the chunk filters; ``out``, ``bias``: the logistic unit."""

    embed: np.ndarray
    bytewise: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Embedded bytes under the byte filters, for each of their places in each row of ``codes``."""
        embedded = np.concatenate([self.embed, np.zeros((1, EMBED), np.float32)])[codes]
        rows, length, _ = embedded.shape
        by_row, by_byte, by_value = embedded.strides
        shape = (rows, (length - WIDTH) // STEP + 1, WIDTH * EMBED)
        return np.lib.stride_tricks.as_strided(embedded, shape, (by_row, STEP * by_byte, by_value)).reshape(-1, WIDTH * EMBED)

    def responses(self, windows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Rectified responses of the byte filters; none at a place whose last bytes are none."""
        found = windows @ self.bytewise
        found += self.offset
        np.maximum(found, 0, out=found)
        found[codes[:, WIDTH - STEP :: STEP].ravel() == _PAD] = 0
        return found

    def channels(self, codes: np.ndarray) -> np.ndarray:
        """Channels of each cell; the first cell only precedes."""
        out = np.zeros((len(codes) // CELL, CHANNELS), np.float32)
        row = codes[None, CELL - (WIDTH - STEP) :]
        out[1:, :BYTE_FILTERS] = self.responses(self.windows(row), row).reshape(len(out) - 1, CELL // STEP, BYTE_FILTERS).mean(axis=1)
        out[:, BYTE_FILTERS:] = _repeats(codes)
        return out

    def best(self, pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece the greatest response of each chunk filter, and the cell at which that chunk starts; all channels."""
        channels = self.channels(pack.codes)
        halves = channels @ np.hstack([self.left, self.right])
        z = halves[:-1, :FILTERS] + halves[1:, FILTERS:] + self.shift
        best, at = np.empty((len(pack.first), FILTERS), np.float32), np.empty((len(pack.first), FILTERS), np.int64)
        for k, (first, cells) in enumerate(zip(pack.first, pack.cells, strict=True)):
            own = z[first : first + cells - 1]
            at[k] = own.argmax(axis=0)
            best[k] = own[at[k], np.arange(FILTERS)]
            at[k] += first
        return best, at, channels

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Probabilities of texts."""
        texts = list(texts)
        pooled = np.full((len(texts), FILTERS), 0, np.float32)
        for pack in packs(texts):
            np.maximum.at(pooled, pack.owner, self.best(pack)[0])
        return _logistic(pooled.astype(np.float64) @ self.out.astype(np.float64) + float(self.bias[0]))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _new(rng: np.random.Generator) -> Network:
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        draw(0.5, 256, EMBED), draw(0.3, WIDTH * EMBED, BYTE_FILTERS), np.zeros(BYTE_FILTERS, np.float32),
        draw(0.3, CHANNELS, FILTERS), draw(0.3, CHANNELS, FILTERS), np.zeros(FILTERS, np.float32),
        draw(0.3, FILTERS), np.zeros(1, np.float32),
    )


def gradients(net: Network, texts: list[str | None], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted logistic loss, in the order of the fields of :class:`Network`."""
    pooled = np.full((len(texts), FILTERS), -np.inf, np.float32)
    found = []
    for pack in packs(texts):
        best, at, channels = net.best(pack)
        np.maximum.at(pooled, pack.owner, best)
        found.append((pack, best, at, channels))
    delta = ((_logistic(np.maximum(pooled, 0) @ net.out + net.bias[0]) - y) * weight).astype(np.float32)
    total = [np.zeros_like(p) for p in vars(net).values()]
    g_embed, g_bytewise, g_offset, g_left, g_right, g_shift, g_out, g_bias = total
    g_out += np.maximum(pooled, 0).T @ delta
    g_bias += delta.sum()
    for pack, best, at, channels in found:
        up = delta[pack.owner][:, None] * net.out * ((best > 0) & (best == pooled[pack.owner]))
        piece, f = np.nonzero(up)
        if not len(piece):
            continue
        up, cell = up[piece, f], at[piece, f]
        np.add.at(g_shift, f, up)
        np.add.at(g_left.T, f, channels[cell] * up[:, None])
        np.add.at(g_right.T, f, channels[cell + 1] * up[:, None])
        # back to the byte filters, in the cells of the chunks that were greatest
        to_cells = np.zeros((len(channels), BYTE_FILTERS), np.float32)
        np.add.at(to_cells, cell, up[:, None] * net.left[:BYTE_FILTERS, f].T)
        np.add.at(to_cells, cell + 1, up[:, None] * net.right[:BYTE_FILTERS, f].T)
        used = np.unique(np.concatenate([cell, cell + 1]))
        around = pack.codes.reshape(-1, CELL)
        codes = np.concatenate([around[used - 1, CELL - (WIDTH - STEP) :], around[used]], axis=1)
        windows = net.windows(codes)
        back = np.repeat(to_cells[used] / (CELL // STEP), CELL // STEP, axis=0) * (net.responses(windows, codes) > 0)
        g_bytewise += windows.T @ back
        g_offset += back.sum(axis=0)
        to_embed = (back @ net.bytewise.T).reshape(len(used), CELL // STEP, WIDTH, EMBED)
        for j in range(WIDTH):
            code = codes[:, j : j + CELL : STEP].ravel()
            for e in range(EMBED):
                g_embed[:, e] += np.bincount(code, to_embed[:, :, j, e].ravel(), 257)[:256].astype(np.float32)
    return total


def train(texts: list[str | None], labels: list[int], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Network:
    """Fit the network to 0/1 labels by Adam over small batches, both classes weighing alike.

    With rows of one class only (or none) the score is a constant: 1, 0 or 0.5.
    """
    rng = np.random.default_rng(seed)
    net = _new(rng)
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.bias[:] = 0.0 if not len(y) else 30.0 if y[0] else -30.0
        return net
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
    params = list(vars(net).values())
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    turn = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if not len(turn):
            turn = rng.permutation(len(y))
        batch, turn = turn[:BATCH], turn[BATCH:]
        for i, g in enumerate(gradients(net, [texts[j] for j in batch], y[batch], weight[batch] / len(batch))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            slope = (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
            params[i] -= (rate * min(1.0, 2 * (1 - step / (steps + 1))) * slope).astype(np.float32)
    return net


def held_out(id_col):  # noqa: ANN001, ANN201
    """Whether the CRC-32 of the id, as text, leaves 2 when divided by 4; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Network:
    """Train on at most ``train_rows`` labelled rows of each class that are not held out.

    Rows are chosen, among those that ``docs`` has, by a hash of their id, so
    reruns train alike; their texts are taken whole, however long. Null ids,
    labels and texts are left out, repeated rows count once, and an id with both
    labels counts for neither. The driver holds the chosen texts.
    """
    known = (
        labels.where(f"{label_col} in (0, 1)")
        .where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("labelled_id"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
        .where("label = most")
        .select("labelled_id", "label")
    )
    rows = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).alias("sample"), F.xxhash64(text_col).alias("tie")).where("sample is not null")
    there = keep(rows.select("labelled_id", "tie").join(known, "labelled_id").distinct(), "labelled")
    order = [F.xxhash64("labelled_id"), "labelled_id", "tie"]
    chosen = [row for label in (0, 1) for row in there.where(F.col("label") == label).orderBy(*order).limit(train_rows).collect()]
    forget(there)
    if not chosen:
        return train([], [])
    picked = docs.sparkSession.createDataFrame(chosen, "labelled_id bigint, tie bigint, label int")  # at most 2 * train_rows rows
    texts = rows.join(F.broadcast(picked), ["labelled_id", "tie"]).dropDuplicates(["labelled_id", "tie"]).select("labelled_id", "tie", "sample", "label").collect()
    texts.sort(key=lambda r: (r["labelled_id"], r["tie"]))
    return train([r["sample"] for r in texts], [r["label"] for r in texts])


def score(docs: DataFrame, net: Network, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability, 0 to 1, that a text is good; a narrow stage.

    Null and empty texts are scored like a text without bytes; repeated rows are
    scored alike; an empty table gives no rows; a column named ``into`` that
    ``docs`` has already is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return docs.withColumn(into, scores(F.col(text_col)))
