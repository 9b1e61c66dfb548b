"""Toxic spans by a linear-chain conditional random field.

The field is learned from tokens. Where only whole documents are labelled, token labels are
derived: a word is an offence if it is far more common in toxic passages than in clean ones and
turns up in many different contexts there; copies of a passage count once, so they neither make
nor unmake an offence. Forward-backward marginals then give every token of a text its probability; tokens over
one half form the spans, and the likeliest token and the expected number of further offences in
spans, weighed by a fit on the labelled documents, make its score. The fit has no constant and no
negative weight, so a text scores over one half if and only if it has a span, however long it is,
and clean words around an offence hide nothing.

Bounds of the fit, which runs in one task and returns the model alone: `sample` labelled documents of each class, chosen
by hash, cut into passages of 256 words of which `passages` are taken per class, and
`vocabulary` words. Scores cover all documents and whole texts.
"""

import pickle
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm import crf
from tripledger.llm.text import byte_texts, held_out

PASSAGE = 256
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’…¿¡"
STEMS = (4, 5, 6, 7)  # lengths of the word beginnings that may be learned as offences
TOKEN = re.compile(r"\S+")
SPANS = "array<struct<start:int,end:int,p:double>>"


def normal(token: str) -> str:
    return token.strip(EDGES)


class Ids(dict):
    """Vocabulary ids by token as it stands in a lower-cased text: that of its shortest known
    stem, else that of its normal form, else 0. Remembers tokens it has seen, up to a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        get, word = self.vocabulary.get, normal(token)
        found = next((i for n in STEMS if len(word) > n and (i := get(word[:n] + "*"))), 0) or get(word, 0)
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found


@dataclass
class Scorer:
    """The field and the calibration from its evidence to a document score."""

    model: crf.Model
    weights: np.ndarray
    known: Ids | None = None  # set where the scorer runs

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.weights, -500, 500)))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores and spans of some texts."""
        if self.known is None:
            self.known = Ids(self.model.vocabulary)
        ids, lengths = encode(texts, self.known)
        p = self.model.tag(ids, lengths)
        spans: list[list[dict]] = [[] for _ in texts]
        ends = np.cumsum(lengths)
        hits = np.flatnonzero(p >= 0.5)
        where = np.searchsorted(ends, hits, side="right")
        for doc in np.unique(where):
            own = hits[where == doc]
            spans[doc] = offsets(texts[doc], own - (ends[doc] - lengths[doc]), p[own])
        return self.score(evidence(p, lengths)), spans


def encode(texts: list[str], known: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary ids of all tokens in a row, and tokens per text."""
    lists = [list(map(known.__getitem__, text.lower().split())) for text in texts]
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    ids = np.fromiter((i for row in lists for i in row), dtype=np.int64, count=int(lengths.sum()))
    return ids, lengths


def evidence(p: np.ndarray, lengths: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
    """What the marginals say about each text: the log-odds of its likeliest token, which are
    negative without a span, and the logarithm of one more than its expected number of further
    offences in spans.

    texts: the text number of each sequence, where several sequences make up a text.
    """
    which = np.repeat(np.arange(len(lengths)) if texts is None else texts, lengths)
    n = len(lengths) if texts is None else int(texts.max(initial=-1)) + 1
    top = np.zeros(n)
    np.maximum.at(top, which, p)
    total = np.bincount(which, np.where(p >= 0.5, p, 0), n)
    further = np.maximum(0, total - np.where(top >= 0.5, top, 0))
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(top / (1 - top)), np.log1p(further)])


RIDGE = 0.1


def objective(weights: np.ndarray, found: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Penalised negative log-likelihood of a logistic fit."""
    z = found @ weights
    return float(weight @ (np.logaddexp(0, z) - label * z) + RIDGE / 2 * weights @ weights)


def class_weights(label: np.ndarray, share: float) -> np.ndarray:
    """Weights by which the classes of a sample weigh what they do among all labels."""
    toxic = np.clip(label.mean(), 1e-9, 1 - 1e-9)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.where(label > 0, share / toxic, (1 - share) / (1 - toxic))


def calibrate(found: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """Weights, none negative, of greatest penalised likelihood. Newton steps are halved until the
    objective falls, and the fit has settled once its gradient vanishes, else it raises. A weight
    that would be negative is zero, and the others are fitted without it."""
    weight, free = class_weights(label, share), np.ones(found.shape[1], dtype=bool)
    while True:
        x, w = found[:, free], np.zeros(int(free.sum()))
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient = x.T @ (weight * (q - label)) + RIDGE * w
            if np.abs(gradient).max(initial=0) < 1e-7 * max(1.0, float(weight.sum())):
                break
            curve = (x * (weight * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(len(w))
            move, step, now = np.linalg.solve(curve, gradient), 1.0, objective(w, x, label, weight)
            while objective(w - step * move, x, label, weight) > now - 1e-4 * step * gradient @ move and step > 1e-12:
                step /= 2
            w = w - step * move
        else:
            raise RuntimeError("the calibration did not settle")
        if (w >= 0).all():
            break
        free[np.flatnonzero(free)[w < 0]] = False
    weights = np.zeros(found.shape[1])
    weights[free] = w
    weights[0] = max(weights[0], 1e-3)  # the likeliest token always decides
    return weights


def offsets(text: str, tokens: np.ndarray, p: np.ndarray) -> list[dict]:
    """Spans in code points, end exclusive; neighbouring tokens share one."""
    places = list(TOKEN.finditer(text))
    spans: list[dict] = []
    for token, chance in zip(tokens.tolist(), p.tolist()):
        start, end = places[token].span()
        if spans and spans[-1]["token"] == token - 1:
            spans[-1] |= {"end": end, "token": token, "p": max(chance, spans[-1]["p"])}
        else:
            spans.append({"start": start, "end": end, "token": token, "p": chance})
    return [{k: s[k] for k in ("start", "end", "p")} for s in spans]


def _passages(batches):
    """Rows (toxic, passage, doc): the texts cut into passages of PASSAGE words, lower-cased."""
    for batch in batches:
        toxic, keys = batch.column("toxic").to_pylist(), batch.column("key").to_pylist()
        for label, key, text in zip(toxic, keys, byte_texts(batch.column("text"))):
            words = text.decode("utf-8", "replace").lower().split()
            cut = [" ".join(words[i : i + PASSAGE]) for i in range(0, len(words), PASSAGE)] or [""]
            yield pa.RecordBatch.from_pydict(
                {"toxic": pa.array([label] * len(cut), pa.int32()), "key": [key] * len(cut),
                 "part": pa.array(range(len(cut)), pa.int32()), "passage": cut}
            )


def training_passages(docs: DataFrame, labels: DataFrame, sample: int, passages: int) -> tuple[DataFrame, float]:
    """(toxic, key, part, passage), at most `passages` passages of each class from `sample` documents each, and the share of
    toxic documents among all labelled ones that may be learned from."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id"))
    chosen = [known.where(F.col("toxic") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    # at most 2 * sample rows of two numbers
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "key"))
    texts = docs.select(F.col("doc_id").alias("key"), "text").join(chosen, "key").select("toxic", "key", "text")
    cut = texts.mapInArrow(_passages, "toxic int, key long, part int, passage string")
    rank = (F.xxhash64(F.lit(13), "key"), F.col("key"), F.col("part"), F.col("passage"))
    taken = [cut.where(F.col("toxic") == c).orderBy(*rank).limit(passages) for c in (0, 1)]
    return taken[0].unionByName(taken[1]), counts.get(1, 0) / max(1, sum(counts.values()))


def offences(words: list[list[str]], toxic: np.ndarray, ratio: float = 20.0, contexts: int = 6,
             kinds: int = 4) -> set[str]:
    """Words, and stems with a star, that mark toxic passages: `ratio` times as common there as
    in clean passages, in `contexts` different contexts at least, and in nearly as many contexts
    as places. Equal passages of a class count once. A stem also needs `kinds` different words; else
    the words stand for themselves."""
    distinct = dict.fromkeys((label, tuple(row)) for row, label in zip(words, toxic.tolist()))
    count, n = {0: Counter(), 1: Counter()}, Counter(label for label, _ in distinct)
    seen, places, words_of = defaultdict(set), Counter(), defaultdict(set)
    for label, row in distinct:
        forms = [[w, *(w[:n] + "*" for n in STEMS if len(w) > n)] for w in row]
        count[label].update({f for some in forms for f in some})
        if label:
            for i, some in enumerate(forms):
                around = (row[i - 1] if i else "", row[i + 1] if i + 1 < len(row) else "")
                for f in some:
                    places[f] += 1
                    words_of[f].add(some[0])
                    if len(seen[f]) < 200:
                        seen[f].add(around)
    found = set()
    for w, hits in count[1].items():
        odds = ((hits + 0.5) / max(1, n[1])) / ((count[0][w] + 0.5) / max(1, n[0]))
        if w and odds >= ratio and len(seen[w]) >= max(contexts, 0.6 * min(places[w], 200)):
            if not w.endswith("*") or len(words_of[w]) >= kinds:
                found.add(w)
    # what a shorter stem covers needs no entry of its own
    return {w for w in found if not any(w[:n] + "*" in found for n in STEMS if n < len(w.rstrip("*")))}


def repeated(ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray, passages: int = 300,
             times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences, and `passages` of those with offences once more with every offence said
    several times: an offence beside another is none the less one, which passages may not show."""
    ends = np.cumsum(lengths)
    chosen = [i for i in range(len(lengths)) if tags[ends[i] - lengths[i] : ends[i]].any()][:passages]
    rows = [np.arange(ends[i] - lengths[i], ends[i]) for i in chosen]
    more = [np.repeat(r, np.where(tags[r] > 0, times, 1)) for r in rows]
    at = np.concatenate([np.arange(len(ids)), *more])
    return ids[at], tags[at], np.concatenate([lengths, np.array([len(m) for m in more], dtype=np.int64)])


def train(frame: pd.DataFrame, share: float, vocabulary: int = 3000, l2: float = 0.3) -> Scorer | None:
    """The scorer, or None if a class is missing."""
    if set(frame["toxic"]) != {0, 1}:
        return None
    frame = frame.sort_values(["key", "part", "passage"], kind="stable")
    toxic = frame["toxic"].to_numpy(np.int64)
    words = [[normal(w) for w in passage.split()] for passage in frame["passage"]]
    bad = offences(words, toxic)
    common = Counter(w for row in words for w in row if w and w not in bad)
    kept = sorted(bad) + [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    names = {w: i + 2 for i, w in enumerate(kept[: max(vocabulary, len(bad))])}
    ids, lengths = encode(frame["passage"].tolist(), Ids(names))
    tags = np.repeat(toxic, lengths) & np.isin(ids, [names[w] for w in bad])
    model = crf.fit(names, *repeated(ids, tags, lengths), l2=l2)
    # calibration: the sampled documents
    doc, first = np.unique(frame["key"].to_numpy(), return_index=True)
    found = evidence(model.tag(ids, lengths), lengths, np.searchsorted(doc, frame["key"].to_numpy()))
    return Scorer(model, calibrate(found, toxic[first].astype(float), share))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, passages: int = 2500) -> Scorer | None:
    """Learn from labelled documents whose remainder allows it. labels: doc_id, toxic; of a
    repeated doc_id, toxic wins; null labels say nothing."""
    passages_, share = training_passages(docs, labels, sample, passages)

    def learn(batches):
        rows = [b.to_pandas() for b in batches]
        scorer = train(pd.concat(rows, ignore_index=True), share) if rows else None
        parts = scorer and (vars(scorer.model), scorer.weights)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(parts)], pa.binary())})

    # one task learns from the bounded sample; the driver sees the weights
    parts = pickle.loads(passages_.repartition(1).mapInArrow(learn, "model binary").first().model)
    return parts and Scorer(crf.Model(**parts[0]), parts[1])


def tagged(text: Column, scorer: Scorer | None) -> Column:
    """Struct (score, spans) of a text. Null and empty texts get the score of no evidence and no
    spans. Without a scorer every score is 0: there is no label to go by."""
    if scorer is None:
        return F.struct(F.lit(0.0).alias("score"), F.lit(None).cast(SPANS).alias("spans"))

    kind = pa.struct(
        [("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))]
    )

    @F.arrow_udf(f"struct<score:double,spans:{SPANS}>")
    def tag(texts: pa.Array) -> pa.Array:
        scores, spans, held, size = [], [], [], 0
        for text in byte_texts(texts):
            held.append(text.decode("utf-8", "replace"))
            size += len(text)
            if size > 4_000_000:  # bounds what the arrays of one step hold
                _extend(scores, spans, scorer.batch(held))
                held, size = [], 0
        _extend(scores, spans, scorer.batch(held))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind.field("spans").type)], fields=list(kind))

    return tag(text)


def _extend(scores: list, spans: list, found: tuple) -> None:
    scores.extend(found[0].tolist())
    spans.extend(found[1])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row of docs; repeated rows stay."""
    scorer = fit(docs, labels)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), tagged(F.col("text"), scorer).alias("t"))
    return found.select(
        "doc_id", "held_out", F.col("t.score").alias("score"),
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
        F.coalesce("t.spans", F.array().cast(SPANS)).alias("spans"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at or over the threshold; all columns are kept."""
    scorer = fit(docs, labels)
    return docs.where(tagged(F.col("text"), scorer).getField("score") < threshold)
