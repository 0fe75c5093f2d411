"""Language of whole texts by a small convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.llm.batches import score_texts
from taskatlas.llm.samples import fold, labelled_texts

WINDOW = 128  # bytes of a window
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
CHUNK = 128  # windows that are run at once
# Small letters, digits as one class, control characters as blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b < 32 else b for b in range(256))
NO_LANGUAGE = "und"


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text as rows of ``size``; the last row is filled with zeros."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, size)


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


class ByteNetwork:
    """Byte embedding, filters of several widths, max over the window, softmax."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        widest = max(WIDTHS)
        # All widths as one product: shorter filters are padded with zeros at their end.
        whole = np.zeros((widest * EMBED, len(WIDTHS) * FILTERS), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            whole[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = params[f"w{w}"].reshape(w * EMBED, FILTERS)
        self.whole = whole

    @staticmethod
    def start(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        p = {"e": draw(256, EMBED, scale=0.5), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        for w in WIDTHS:
            p[f"w{w}"] = draw(w * EMBED, FILTERS, scale=(2.0 / (w * EMBED)) ** 0.5)
        p["o"] = draw(len(WIDTHS) * FILTERS, classes, scale=0.1)
        p["c"] = np.zeros(classes, np.float32)
        return p

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """Embedded bytes of each place and the ones after it, in one row for a product."""
        widest = max(WIDTHS)
        padded = np.zeros((len(rows), rows.shape[1] + widest - 1), dtype=np.uint8)
        padded[:, : rows.shape[1]] = rows
        flat = self.p["e"][padded]
        step = flat.strides
        view = np.lib.stride_tricks.as_strided(flat, (len(rows), rows.shape[1], widest * EMBED), (step[0], step[1], step[2]))
        return view.reshape(len(rows) * rows.shape[1], widest * EMBED)

    def pooled(self, rows: np.ndarray, *, places: bool = False):
        out = (self.columns(rows) @ self.whole).reshape(len(rows), rows.shape[1], -1)
        if places:
            at = out.argmax(1)
            top = np.take_along_axis(out, at[:, None, :], 1)[:, 0, :] + self.p["b"]
            return np.maximum(top, 0.0), at
        return np.maximum(out.max(1) + self.p["b"], 0.0)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        parts = [softmax(self.pooled(rows[i : i + CHUNK]) @ self.p["o"] + self.p["c"]) for i in range(0, len(rows), CHUNK)]
        return np.concatenate(parts)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_network(rows: np.ndarray, labels: np.ndarray, classes: int, *, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 11) -> ByteNetwork:
    """Adam on cross-entropy; the gradient of the max goes to the place that won."""
    rng = np.random.default_rng(seed)
    p = ByteNetwork.start(classes, rng)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    widest = max(WIDTHS)
    for _epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = rows[pick].copy()
            # Some windows are cut short, as ends of texts are.
            for i in np.flatnonzero(rng.random(len(pick)) < 0.25):
                x[i, rng.integers(4, WINDOW) :] = 0
            net = ByteNetwork(p)
            h, places = net.pooled(x, places=True)
            d = softmax(h @ p["o"] + p["c"])
            d[np.arange(len(pick)), labels[pick]] -= 1.0
            d /= len(pick)
            g = {"o": h.T @ d, "c": d.sum(0)}
            dh = (d @ p["o"].T) * (h > 0)
            g["b"] = dh.sum(0)
            g["e"] = np.zeros_like(p["e"])
            padded = np.zeros((len(pick), WINDOW + widest - 1), dtype=np.uint8)
            padded[:, :WINDOW] = x
            who = np.arange(len(pick))[:, None]
            for i, w in enumerate(WIDTHS):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                seen = padded[who[:, :, None], places[:, cols][:, :, None] + np.arange(w)[None, None, :]]
                patch = p["e"][seen].reshape(len(pick), FILTERS, w * EMBED)
                g[f"w{w}"] = np.einsum("bf,bfk->kf", dh[:, cols], patch)
                back = np.einsum("bf,kf->bfk", dh[:, cols], p[f"w{w}"]).reshape(-1, EMBED)
                np.add.at(g["e"], seen.reshape(-1), back)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNetwork(p)


def training_windows(sample: DataFrame, per_text: int) -> tuple[np.ndarray, list[str]]:
    """Evenly spread windows of each text of the bounded sample, and their languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, langs = [], []
            for text, lang in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                if text and any(map(str.isalpha, text)):
                    rows = windows(folded(text))
                    for i in sorted({len(rows) * j // per_text for j in range(per_text)}):
                        cut.append(rows[i].tobytes())
                        langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(langs, pa.string())], names=["window", "lang"])

    got = sample.select("text", "label").mapInArrow(run, "window binary, lang string").orderBy(F.xxhash64("window"), "window").toArrow()
    flat = b"".join(got["window"].to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), got["lang"].to_pylist()


def identify_languages(
    documents: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    max_rows_per_language: int = 1_000, windows_per_text: int = 4,
) -> DataFrame:
    """Per row: ``doc_id, lang_pred, score``.

    ``labelled`` has the id, ``text`` and ``label`` columns of the rows to learn from;
    at most ``max_rows_per_language`` texts of each language and ``windows_per_text``
    windows of each are used. A text is read whole, in windows of 128 bytes; its
    language has the largest probability, averaged over windows by their bytes.

    A null text or one without a letter is ``und`` with score 0; so is every text
    when there is nothing to learn from. Repeated rows repeat, other columns are
    ignored, an empty table gives no rows. Fits while the plan is built.
    """
    sample = labelled_texts(labelled, labelled, max_rows_per_language, id_col=id_col, text_col=text_col)
    cut, langs = training_windows(sample, windows_per_text)
    names = sorted(set(langs))
    params = fit_network(cut, np.array([names.index(x) for x in langs]), len(names)).p if names else None

    def make():
        net = ByteNetwork(params) if names else None

        def run(texts: list[str | None]) -> list[list]:
            chosen, score = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
            named = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            data = [folded(texts[i]) for i in named]
            # Long texts in parts, so the windows of a batch stay within bounds.
            at = 0
            while at < len(named):
                end, size = at, 0
                while end < len(named) and (end == at or size + len(data[end]) <= 1 << 20):
                    size += len(data[end])
                    end += 1
                parts = [windows(d) for d in data[at:end]]
                starts = np.cumsum([0, *map(len, parts)])
                odds = net.probabilities(np.concatenate(parts))
                for j, i in enumerate(named[at:end]):
                    own = odds[starts[j] : starts[j + 1]]
                    weight = np.full(len(own), float(WINDOW))
                    weight[-1] = len(data[at + j]) - WINDOW * (len(own) - 1)
                    mean = (own * weight[:, None]).sum(0) / weight.sum()
                    best = int(mean.argmax())
                    chosen[i], score[i] = names[best], float(min(1.0, mean[best]))
                at = end
            return [chosen, score]

        return run

    return score_texts(documents, id_col, text_col, make, "lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 4, fold_number: int = 2):
    return F.coalesce(fold(F.col(id_col), folds) == fold_number, F.lit(False))
