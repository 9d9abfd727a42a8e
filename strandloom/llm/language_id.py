"""Language identification by a bidirectional gated recurrent network over bytes.

The whole UTF-8 text is cut into windows of WINDOW bytes.  For each window a forward gated
recurrent unit reads the bytes from CONTEXT before it on, and a backward one from CONTEXT
behind it, so that their states span the borders; at every position both states give a
softmax over the languages (the position's label), and a document's probabilities are the
mean over all its positions.  Windows are run in lockstep, many at a time, as numpy arrays laid
out with the window last; lanes that have not reached their text yet keep a state of zero.

The network is trained in numpy by backpropagation through time (Adam, position-wise cross
entropy) on a bounded sample: for each language at most ``per_language`` training documents
with a letter, fewer if there are so many languages that the sample would pass SAMPLE_DOCS
(one each at least: every language is learned), by the order of a hash of doc_id, and from
each WINDOWS_PER_DOC windows of TRAIN_BYTES bytes, cut at borders of characters: one from the
first letter on, the others at hashed places of the whole text.

Cases: a null text, or one with no letter, is ``und`` with score 0; without any labelled
training row everything is ``und``; a null doc_id counts as the empty string for the fold;
rows that repeat are predicted each (equal texts get equal labels); texts of any length
are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texthash
from ._shared import stored, tidy

WINDOW, CONTEXT = 192, 32
HIDDEN = 16
WINDOWS_PER_DOC = 3
TRAIN_BYTES = 96
PER_LANGUAGE = 500
#: Steps of training at least, however few the windows.
LEAST_STEPS = 190
#: Training documents in all.
SAMPLE_DOCS = 128_000
#: Languages up to which batches are of full size; with more they shrink.
FULL_BATCH_LANGUAGES = 256
#: A document counts as in no learned language if its pooled probability is not so much (of
#: what is left to 1) above that of a guess.
REJECT_MARGIN = 0.07
#: Bytes of text in a lockstep batch.
BATCH_BYTES = 131_072

_LETTER = regex.compile(r"\p{L}")
f4 = np.float32


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


@dataclass
class Model:
    languages: list[str]
    x: np.ndarray  # (2, 256, 3H) input part of the gates: update, reset, candidate
    u: np.ndarray  # (2, 3H, H) recurrent part
    v: np.ndarray  # (C, 2H)
    b: np.ndarray  # (C,)

    def params(self):
        return [self.x, self.u, self.v, self.b]


def _states(x: np.ndarray, u: np.ndarray, steps: np.ndarray, keep: bool, real: np.ndarray | None = None):
    """States (T, H, L) of one direction over byte rows ``steps`` (T, L); with ``keep`` also
    what backpropagation needs.  Where ``real`` is 0 the state is set to zero."""
    t_max, lanes = steps.shape
    h3 = u.shape[0]
    hid = h3 // 3
    out = np.empty((t_max, hid, lanes), x.dtype)
    h = np.zeros((hid, lanes), x.dtype)
    saved = []
    one, half = x.dtype.type(1), x.dtype.type(0.5)
    # sigmoid(a) is (1 + tanh(a / 2)) / 2
    scale = np.concatenate([np.full(2 * hid, half), np.full(hid, one)]).astype(x.dtype)
    xt, us = np.ascontiguousarray((x * scale).T), u * scale[:, None]
    gaps = None if real is None else ~real.astype(bool).all(axis=1)
    for t in range(t_max):
        gates = xt.take(steps[t], axis=1)
        rec = us @ h
        zr = gates[: 2 * hid]
        zr += rec[: 2 * hid]
        np.tanh(zr, out=zr)
        zr += one
        zr *= half
        z, r = zr[:hid], zr[hid:]
        n = gates[2 * hid :]
        rn = rec[2 * hid :]
        if keep:
            n += r * rn
        else:
            rn *= r
            n += rn
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if gaps is not None and gaps[t]:
            new *= real[t]
        if keep:
            saved.append((z, r, n, rn, h))
        h = new
    return (out, saved) if keep else out


def _probabilities(model: Model, rows: np.ndarray, real: np.ndarray, context: int = 0) -> np.ndarray:
    """(T - 2 context, C, L) position probabilities of byte rows (T, L) with ``context`` more at
    both ends; ``real`` (T, L) tells text from what lies outside of it."""
    t_max = len(rows)
    upto, back = slice(0, t_max - context), slice(None, context - 1 if context else None, -1)
    fwd = _states(model.x[0], model.u[0], rows[upto], False, real[upto])[context:]
    bwd = _states(model.x[1], model.u[1], rows[back], False, real[back])[: context - 1 if context else None : -1]
    hid = fwd.shape[1]
    logits = model.v[:, :hid] @ fwd
    logits += model.v[:, hid:] @ bwd
    logits += model.b[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _gradient(model: Model, rows: np.ndarray, mask: np.ndarray, target: np.ndarray):
    """Loss and gradients by backpropagation through time."""
    t_max, lanes = rows.shape
    hid = model.u.shape[2]
    sides, reals = [rows, rows[::-1]], [mask, mask[::-1]]
    runs = [_states(model.x[d], model.u[d], sides[d], True, reals[d]) for d in (0, 1)]
    fwd, bwd = runs[0][0], runs[1][0][::-1]
    logits = model.v[:, :hid] @ fwd + model.v[:, hid:] @ bwd + model.b[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    lane = np.arange(lanes)
    n = max(1.0, float(mask.sum()))
    loss = -float((np.log(p[:, target, lane] + 1e-9) * mask).sum()) / n
    d = p
    d[:, target, lane] -= 1
    d *= (mask / n)[:, None, :]
    gv = np.concatenate([np.einsum("tcl,thl->ch", d, fwd), np.einsum("tcl,thl->ch", d, bwd)], axis=1)
    gb = d.sum(axis=(0, 2))
    gx, gu = np.zeros_like(model.x), np.zeros_like(model.u)
    for k in (0, 1):
        out = model.v[:, k * hid : (k + 1) * hid].T @ (d if k == 0 else d[::-1])
        u, back = model.u[k], np.zeros((hid, lanes), f4)
        inputs = np.empty((3 * hid, t_max, lanes), f4)
        for t in range(t_max - 1, -1, -1):
            z, r, cand, rn, h = runs[k][1][t]
            dh = (out[t] + back) * reals[k][t]
            dn = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (h - cand) * z * (1 - z)
            dr = dn * rn * r * (1 - r)
            inputs[:, t] = np.concatenate([dz, dr, dn])
            rec = np.concatenate([dz, dr, dn * r])
            gu[k] += rec @ h.T
            back = dh * z + u.T @ rec
        place = sides[k].ravel()
        for j in range(3 * hid):
            gx[k, :, j] = np.bincount(place, weights=inputs[j].ravel(), minlength=256)
    return loss, [gx, gu, gv.astype(f4), gb.astype(f4)]


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = 8, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Model:
    """Fit a model to byte windows and their documents' languages."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    model = Model(
        languages,
        rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f4),
        rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(f4),
        rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(f4),
        np.zeros(len(languages), f4),
    )
    if not texts:
        return model
    longest = max(map(len, texts))
    rows = np.zeros((longest, len(texts)), np.uint8)
    mask = np.zeros((longest, len(texts)), f4)
    for i, t in enumerate(texts):
        rows[: len(t), i] = np.frombuffer(t, np.uint8)
        mask[: len(t), i] = 1
    place = {x: i for i, x in enumerate(languages)}
    target = np.asarray([place[x] for x in labels])
    batch = max(1, min(batch, 8 * FULL_BATCH_LANGUAGES * batch // len(languages)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.params()]
    steps = -(-len(texts) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // steps))
    step, total = 0, epochs * steps
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, grads = _gradient(model, rows[:, some], mask[:, some], target[some])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for p, g, (m, s) in zip(model.params(), grads, moments):
                m += f4(0.1) * (g - m)
                s += f4(0.01) * (g * g - s)
                p -= f4(lr) * (m / f4(1 - 0.9**step)) / (np.sqrt(s / f4(1 - 0.99**step)) + f4(1e-7))
    return model


def document_probabilities(model: Model, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(documents, languages) mean probability over all positions."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(n), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    start = offsets[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    # windows with much text go together, so that few steps run over lanes without any
    order = np.argsort(-np.minimum(offsets[owner + 1] - start, WINDOW + CONTEXT), kind="stable")
    total = np.zeros((n, len(model.languages)))
    languages = max(len(model.languages), FULL_BATCH_LANGUAGES)
    step = max(1, BATCH_BYTES * FULL_BATCH_LANGUAGES // languages // WINDOW)
    for at in range(0, len(owner), step):
        some = order[at : at + step]
        own, s = owner[some], start[some]
        lo, hi = offsets[own], offsets[own + 1]
        width = int(min(WINDOW, (hi - s).max()))
        place = s[None, :] + np.arange(-CONTEXT, width + CONTEXT)[:, None]
        real = (place >= lo[None, :]) & (place < hi[None, :])
        rows = data[np.where(real, place, s[None, :])]
        real = real.astype(f4)
        p = _probabilities(model, rows, real, CONTEXT)
        p *= real[CONTEXT : CONTEXT + width, None, :]
        sums = p.sum(axis=0, dtype=np.float64)
        for c in range(sums.shape[0]):
            total[:, c] += np.bincount(own, weights=sums[c], minlength=n)
    return total / np.maximum(sizes, 1)[:, None]


def _at_characters(raw: bytes) -> bytes:
    """A stretch of UTF-8 without the parts of characters at its ends."""
    lo, hi = 0, len(raw)
    while lo < min(3, hi) and raw[lo] & 0xC0 == 0x80:
        lo += 1
    for k in range(1, min(4, hi - lo + 1)):
        lead = raw[hi - k]
        if lead & 0xC0 != 0x80:
            wide = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return raw[lo : hi - k if wide > k else hi]
    return raw[lo:hi]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on the labelled documents of the training fold (crc32 of doc_id mod 4 is not 2)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    lettered = F.rlike("text", F.lit(r"\p{L}"))
    # documents of each language; of the large ones a share by hash meets in the window below
    known = stored(labelled.groupBy("lang").agg(F.count_if(lettered).alias("n")), "lid-languages")
    share = max(1, min(per_language, sample_docs // max(1, known.count())))
    part = known.select(F.col("lang").alias("k_lang"), (F.lit(4 * share + 64) / F.greatest("n", F.lit(1))).alias("part"))
    order = F.xxhash64(F.lit(99), "doc_id")
    near = F.pmod(order, F.lit(1 << 32)) <= F.col("part") * (1 << 32)
    raw = F.col("text").cast("binary")
    head = F.octet_length(F.substring("text", F.lit(1), F.regexp_instr("text", F.lit(r"\p{L}")) - 1))
    span = F.greatest(F.lit(1), F.octet_length("text") - TRAIN_BYTES + 1)
    at = [head, *(F.pmod(F.xxhash64(F.lit(k), "doc_id"), span) for k in range(1, WINDOWS_PER_DOC))]
    windows = F.array(*[F.substring(raw, (a + 1).cast("int"), F.lit(TRAIN_BYTES)) for a in at])
    some = labelled.where(lettered).join(part, F.col("lang") == F.col("k_lang")).where(near).select("doc_id", "lang", windows.alias("windows"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 32)), order, "doc_id"))
    sample = some.withColumn("rank", rank).where(F.col("rank") <= share)
    texts, labels = [], []
    for row in sorted(sample.select("lang", "rank", "windows").collect(), key=lambda r: (r["lang"], r["rank"])):
        for w in map(_at_characters, map(bytes, row["windows"])):
            if _LETTER.search(w.decode("utf-8", "replace")):
                texts.append(w)
                labels.append(row["lang"])
    return train(texts, labels)


def _slices(offsets: np.ndarray, languages: int):
    """Ranges of rows of about a million bytes, and of a bounded number of probabilities."""
    rows = max(1, 10_000 * FULL_BATCH_LANGUAGES // max(languages, 1))
    for lo, hi in texthash.slices(offsets, 1_000_000):
        for at in range(lo, hi, rows):
            yield at, min(at + rows, hi)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` with lang_pred and score (after ``prefix``) for every row."""
    keep = keep or ["doc_id"]
    names = [*keep, f"{prefix}lang_pred", f"{prefix}score"]

    def run(batches):
        for batch in batches:
            offsets, data = texthash.buffers(batch.column(0))
            for lo, hi in _slices(offsets, len(model.languages)):
                lettered = _lettered(batch.column(0).slice(lo, hi - lo), offsets[lo : hi + 1], data)
                if model.languages:
                    p = document_probabilities(model, offsets[lo : hi + 1], data)
                    best = p.argmax(axis=1)
                label, score = [], []
                for i, has in enumerate(lettered.tolist()):
                    if not has or not model.languages:
                        label.append("und")
                        score.append(0.0)
                    else:
                        label.append(model.languages[best[i]])
                        score.append(float(min(1.0, p[i, best[i]])))
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(lo, hi - lo) for k in range(len(keep))), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=names)
        tidy()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, f"{kinds}, `{prefix}lang_pred` string, `{prefix}score` double")


def _lettered(texts: pa.Array, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only those without an ASCII letter are decoded."""
    part = data[offsets[0] : offsets[-1]] | 0x20
    seen = np.concatenate([[0], np.cumsum((part >= 97) & (part <= 122))])
    has = seen[offsets[1:] - offsets[0]] > seen[offsets[:-1] - offsets[0]]
    for i in np.flatnonzero(~has):
        has[i] = _LETTER.search(texts[i].as_py() or "") is not None
    return has


def with_letter(docs: DataFrame) -> DataFrame:
    """docs whose text has a letter."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_lettered(batch.column(at), *texthash.buffers(batch.column(at))), pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def drop_rejected(docs: DataFrame, margin: float = REJECT_MARGIN) -> DataFrame:
    """docs without those that have no letter or whose best language has a probability that is
    not ``margin`` (of what is left to 1) above 1 / languages.

    If no language could be learned, nothing is judged: only null texts and texts without a
    letter go.
    """
    model = fit(docs)
    if not model.languages:
        return with_letter(docs)
    guess = 1 / len(model.languages)
    least = (guess + margin * (1 - guess)) * (1 - 1e-6)
    judged = predict(docs, model, docs.columns, "_lid_")
    return judged.where(F.col("_lid_lang_pred") != "und").where(F.col("_lid_score") >= least).select(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model of the training fold."""
    marked = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(marked, fit(docs), ["doc_id", "held_out"])
