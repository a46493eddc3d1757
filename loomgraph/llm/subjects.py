"""Subject areas of documents by a chain of classifiers.

Term features: a mixture over sentences (one class per subject and one for everything else) learns from labelled
documents which terms belong to a subject; each sentence may only take the subjects of its document, or none. It
turns a text into the part of its sentences that deals with each subject. Source and structure features stand beside
these parts: the source in letters and digits, the number of sentences, lists, dialogue, markup. A chain of logistic
classifiers, one a subject, frequent subjects first, reads the features and the subjects already decided, so that
subjects which go together or exclude each other count; each link is calibrated on documents held out of its
training. The most probable combination of subjects is found by beam search along the chain.

Only training happens on the driver, on at most ``SAMPLE`` labelled documents (by hash of the id); what it yields,
terms and weights, is bounded by that sample. All documents are read whole and classified where they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.text import key_form, stripped
from loomgraph.plans.staging import staged

#: Labelled documents that are used for training at most.
SAMPLE = 20_000
#: Characters of a labelled document that is used for training at most; longer ones are classified, not learnt from.
SAMPLE_CHARS = 50_000
#: Subjects at most; more are refused.
SUBJECTS = 1000
#: Labelled documents of the sample that a term must occur in.
TERM_DOCS = 1
#: Rounds of the mixture, smoothing of its counts, prior of a sentence about none of the subjects.
ROUNDS, SMOOTH, NONE_PRIOR = 12, 0.03, 0.4
#: Prior of a subject that a labelled document isn't labelled with, all of these together: wrong labels and passing mentions.
STRAY_PRIOR = 0.06
#: Folds in which the parts of training documents come from terms learnt without them.
FOLDS = 4
#: Parts of sentences at which the features bend.
KNEES = (0.1, 0.15, 0.2, 0.25, 0.35)
#: Hashed sources, combinations kept in the search, ridge of the classifiers.
SOURCES, BEAM, RIDGE = 32, 12, 5.0

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|[\r\n]+")
_TERM = re.compile(r"[^\W\d_]{3,}")
_STRUCTURE = [re.compile(p, re.M) for p in (r"^\s*[-*] ", r"^(user|agent)\s*:", r"^#", r"[{}<>]|```", r"^--\s*$")]


class SubjectModel(NamedTuple):
    """Terms by number, log odds of terms over the rest (terms x subjects), subjects in chain order and the chain's weights."""

    terms: dict[str, int]
    odds: np.ndarray
    subjects: list[str]
    weights: list[np.ndarray]


def sentences_of(text: str) -> list[set[str]]:
    """The terms of each sentence that has any letter; case is levelled."""
    return [terms for s in _SENTENCE.split(text.lower()) if (terms := set(_TERM.findall(s)))]


def structure_of(text: str, source: str | None, sentences: int) -> np.ndarray:
    """Source and structure features."""
    out = np.zeros(SOURCES + len(_STRUCTURE) + 2)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES : SOURCES + len(_STRUCTURE)] = [bool(p.search(text.lower())) for p in _STRUCTURE]
    out[-2:] = np.log1p(sentences), sentences < 5
    return out


def _sums(odds: np.ndarray, sentences: list[list[int]]) -> np.ndarray:
    """Log odds of each sentence's terms, summed by subject."""
    sizes = np.array([len(s) for s in sentences], np.int64)
    flat = np.concatenate([np.array(s, np.int64) for s in sentences]) if len(sizes) else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    return np.stack([np.bincount(at, odds[flat, j], len(sizes)) for j in range(odds.shape[1])], 1)


def _posterior(sums: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Probability of each subject for each sentence; what is missing to one is the rest's."""
    scores = np.concatenate([sums + np.log(prior[..., :-1] + 1e-12), np.broadcast_to(np.log(prior[..., -1:]), (len(sums), 1))], 1)
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return (scores / scores.sum(1, keepdims=True))[:, :-1]


def learn_terms(docs: list[list[list[int]]], labels: np.ndarray, terms: int) -> np.ndarray:
    """Log odds (terms x subjects) of the mixture over the sentences of labelled documents."""
    k = labels.shape[1]
    sentences = [s for d in docs for s in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    count = labels.sum(1, keepdims=True)
    stray = STRAY_PRIOR / np.maximum(k - count, 1)
    prior = np.where(labels, (1 - NONE_PRIOR - STRAY_PRIOR) / np.maximum(count, 1), stray)
    prior = np.concatenate([prior, 1 - prior.sum(1, keepdims=True)], 1)[owner]
    flat = np.concatenate([np.array(s, np.int64) for s in sentences]) if sentences else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    belief = prior[:, :-1].copy()
    odds = np.zeros((terms, k))
    for _ in range(ROUNDS):
        own = np.concatenate([belief, 1 - belief.sum(1, keepdims=True)], 1)
        counts = np.stack([np.bincount(flat, own[at, j], terms) for j in range(k + 1)], 1)
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(0)
        odds = np.log(share[:, :-1]) - np.log(share[:, -1:])
        belief = _posterior(_sums(odds, sentences), prior)
    return odds


def parts_of(odds: np.ndarray, sentences: list[list[int]]) -> np.ndarray:
    """Part of the sentences that deals with each subject."""
    k = odds.shape[1]
    if not sentences:
        return np.zeros(k)
    prior = np.array([(1 - NONE_PRIOR) / k] * k + [NONE_PRIOR])
    return _posterior(_sums(odds, sentences), prior).mean(0)


def features_of(parts: np.ndarray, structure: np.ndarray, j: int) -> np.ndarray:
    """Features of the chain's link ``j`` (rows x features) without the labels already decided."""
    own = parts[:, j : j + 1]
    bent = np.concatenate([np.maximum(own - knee, 0) for knee in KNEES] + [own > knee for knee in KNEES], 1)
    return np.concatenate([np.ones_like(own), own, own * np.expm1(structure[:, -2:-1]).clip(0, 40), bent, parts, parts.max(1, keepdims=True), parts.sum(1, keepdims=True), structure], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_chain(parts: np.ndarray, structure: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Weights of each link, its scale and shift from documents held out (every fifth) folded in."""
    held = np.arange(len(labels)) % 5 == 0
    weights = []
    for j in range(labels.shape[1]):
        x = np.concatenate([features_of(parts, structure, j), labels[:, :j]], 1)
        w = _logistic(x[~held], labels[~held, j], RIDGE)
        if held.any() and 0 < labels[held, j].sum() < held.sum():
            a, b = _logistic(np.stack([x[held] @ w, np.ones(held.sum())], 1), labels[held, j], 1e-3)
            w = w * a
            w[0] += b
        weights.append(w)
    return weights


def decode(parts: np.ndarray, structure: np.ndarray, weights: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """The most probable combination of labels for each row, by beam search along the chain."""
    n, k = len(parts), len(weights)
    kept, score = np.zeros((n, 1, k), bool), np.zeros((n, 1))
    for j, w in enumerate(weights):
        base = features_of(parts, structure, j)
        p = _sigmoid((base @ w[: base.shape[1]])[:, None] + kept[:, :, :j] @ w[base.shape[1] :])
        yes = kept.copy()
        yes[:, :, j] = True
        kept = np.concatenate([kept, yes], 1)
        score = np.concatenate([score + np.log(1 - p + 1e-12), score + np.log(p + 1e-12)], 1)
        if score.shape[1] > beam:
            top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            kept, score = np.take_along_axis(kept, top[:, :, None], 1), np.take_along_axis(score, top, 1)
    return np.take_along_axis(kept, score.argmax(1)[:, None, None], 1)[:, 0]


def fit(texts: list[str], sources: list[str | None], labels: np.ndarray, subjects: list[str]) -> SubjectModel:
    """The model from labelled texts (rows of ``labels``: a truth value a subject)."""
    order = np.argsort(-labels.sum(0), kind="stable")
    labels, subjects = labels[:, order].astype(float), [subjects[i] for i in order]
    cut = [sentences_of(t) for t in texts]
    seen: dict[str, int] = {}
    for doc in cut:
        for term in set().union(*doc):
            seen[term] = seen.get(term, 0) + 1
    terms = {t: i for i, t in enumerate(sorted(t for t, n in seen.items() if n >= TERM_DOCS))}
    numbered = [[[terms[t] for t in s if t in terms] for s in doc] for doc in cut]
    odds = learn_terms(numbered, labels, len(terms))
    # parts as an unlabelled text would have them: terms learnt without the document's own fold
    parts = np.zeros((len(texts), len(subjects)))
    for fold in range(FOLDS):
        rest = np.arange(len(texts)) % FOLDS != fold
        other = learn_terms([d for d, r in zip(numbered, rest) if r], labels[rest], len(terms)) if len(texts) > 30 else odds
        for i in np.flatnonzero(~rest):
            parts[i] = parts_of(other, numbered[i])
    structure = np.array([structure_of(t, s, len(d)) for t, s, d in zip(texts, sources, cut)]).reshape(len(texts), -1)
    return SubjectModel(terms, odds, subjects, learn_chain(parts, structure, labels))


def _classifier(model: SubjectModel):
    """Kernel: (doc_id, text, source) to (doc_id, subject)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = model.terms
        for batch in batches:
            ids, parts, structure = [], [], []
            for doc, text, source in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                cut = sentences_of(text)
                if not cut:
                    continue
                ids.append(doc)
                parts.append(parts_of(model.odds, [[terms[t] for t in s if t in terms] for s in cut]))
                structure.append(structure_of(text, source, len(cut)))
            if ids:
                row, label = np.nonzero(decode(np.array(parts), np.array(structure), model.weights))
                yield pa.record_batch([pa.array(np.array(ids)[row], pa.int64()), pa.array([model.subjects[j] for j in label], pa.string())], ["doc_id", "subject"])

    return kernel


def labelled_sample(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[list[str], list[str | None], np.ndarray]:
    """Texts, sources and labels of at most SAMPLE labelled documents; labels compare without outer blanks in any letter case."""
    known = labels.select("doc_id", F.lower(stripped(F.col("subject"))).alias("subject")).where(F.col("subject").isin([s.lower() for s in subjects]) & F.col("doc_id").isNotNull())
    by_doc = known.groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))  # no more than SUBJECTS
    fitting = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id")
    by_doc = by_doc.join(fitting, "doc_id", "left_semi")
    chosen = staged(by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labelled")
    rows = docs.select("doc_id", "text", key_form(F.col("source")).alias("source")).join(F.broadcast(chosen), "doc_id").where("text is not null").orderBy("doc_id").collect()  # at most SAMPLE rows of SAMPLE_CHARS
    place = {s.lower(): i for i, s in enumerate(subjects)}
    y = np.zeros((len(rows), len(subjects)), bool)
    for i, r in enumerate(rows):
        y[i, [place[s] for s in r["labels"]]] = True
    return [r["text"] for r in rows], [r["source"] for r in rows], y


def classified(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject) of every document and subject it is about; no row for a document about none.

    Null, empty and letterless texts are about nothing. Without labels of the listed subjects the result is empty.
    """
    subjects = [r["subject"] for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").limit(SUBJECTS + 1).collect()]
    if len(subjects) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    texts, sources, y = labelled_sample(docs, labels, subjects)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key_form(F.col("source")).alias("source"))
    if not y.any():
        return rows.where(F.lit(False)).select("doc_id", F.lit("").alias("subject"))
    return rows.mapInArrow(_classifier(fit(texts, sources, y, subjects)), "doc_id long, subject string")
