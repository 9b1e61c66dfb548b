"""Languages of a document as a mixture, by expectation-maximisation over its words.

Every language has a character n-gram model with interpolated smoothing, counted over all
documents that may be learned from. A word of a text is one draw from the mixture: its
likelihood under a language is the product over its characters, each with the two before it.
EM estimates the proportions of the languages; languages are dropped one by one, the smallest
first, as long as the penalised likelihood (BIC: half the logarithm of the number of words per
free proportion) gets no worse. The largest proportion names the language.

The models are tables over hashed n-grams, 2 ** `bits` cells per language and order; their size
does not grow with the data, and counting them is a partial aggregate of at most that many rows
per language. There are as many languages as labels differ; the number of rows they may bring to
the driver is checked.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.text import byte_texts, code_points, held_out

ORDERS = (3, 1)
WEIGHTS = (0.95, 0.05)
SPACE = 32
UNKNOWN = "und"
MOST_ROWS = 20_000_000
BREAK = chr(0x10FFFF)  # a code point that no character has
LETTERS = np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, text of each): the lower-case letters of all texts, with one space before
    each word."""
    joined = BREAK + BREAK.join(texts).lower()
    if joined.count(BREAK) != len(texts):
        joined = BREAK + BREAK.join(t.replace(BREAK, " ") for t in texts).lower()
    flat = code_points(joined).copy()
    text = np.cumsum(flat == ord(BREAK)) - 1
    letter = np.unpackbits(LETTERS).view(bool)[flat]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    flat[~letter] = SPACE
    return flat[keep], text[keep]


def cells(chars: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The table cell of the n-gram that ends at each character, of order 1 or 3. N-grams do not
    reach back over the space before a word."""
    out = chars.astype(np.uint64)
    if order == 3:
        one, two = np.full_like(out, SPACE), np.full_like(out, SPACE)
        one[1:], two[2:] = out[:-1], out[:-2]
        two[one == SPACE] = SPACE
        out |= one << np.uint64(21) | two << np.uint64(42)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _count(bits: int):
    """(lang, size, cell, n) of the n-grams in a batch."""

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            rows, size = [], 0
            for lang, text in zip(langs, byte_texts(batch.column("text"))):
                rows.append((lang, text.decode("utf-8", "replace")))
                size += len(text)
                if size > 4_000_000:
                    yield from _counted(rows, bits)
                    rows, size = [], 0
            yield from _counted(rows, bits)

    return count


def _counted(rows: list[tuple[str, str]], bits: int):
    for lang in sorted({r[0] for r in rows}):
        chars, _ = letters([t for g, t in rows if g == lang])
        for order in ORDERS:
            n = np.bincount(cells(chars, order, bits)[chars != SPACE], minlength=1 << bits)
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(used), "size": np.full(len(used), order, np.int32), "cell": used, "n": n[used]}
                )


@dataclass
class Model:
    """Log-probability of each n-gram cell, per language."""

    languages: list[str]
    tables: dict[int, np.ndarray]  # order: (cells, languages), counts as shares of all letters
    bits: int

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods, text) of every word of the texts; words by languages."""
        chars, text = letters(texts)
        inside = chars != SPACE
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])[: len(inside)])
        if not len(starts):
            return np.empty((0, len(self.languages))), np.empty(0, np.int64)
        at = np.flatnonzero(inside)
        # shares of the three-letter window, backed off to the letter
        likely = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        for order, weight in zip(ORDERS, WEIGHTS):
            likely += np.float32(weight) * self.tables[order][cells(chars, order, self.bits)[at]]
        total = np.add.reduceat(np.log(likely), np.searchsorted(at, starts), axis=0)
        return total.astype(np.float64), text[starts]


def settle(theta: np.ndarray, which: np.ndarray, like: np.ndarray, text: np.ndarray, rounds: int, tolerance: float):
    """EM on the texts `which`, side by side; a text whose proportions have settled is set aside.
    Returns (proportions, log-likelihood of the words), both for all texts."""
    theta, value = theta.copy(), np.zeros(len(theta))
    live = np.zeros(len(theta), dtype=bool)
    live[which] = True
    rows = chosen = np.flatnonzero(live[text])
    size = np.bincount(text, minlength=len(theta))
    for _ in range(rounds):
        if not len(rows):
            break
        t = text[rows]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        names = t[starts]
        joint = like[rows] * theta[t]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, starts) / size[names][:, None]
        live[names] = np.abs(new - theta[names]).max(axis=1) >= tolerance
        theta[names] = new
        rows = rows[live[t]]
    if len(chosen):
        t = text[chosen]
        value = np.bincount(t, np.log((like[chosen] * theta[t]).sum(axis=1)), len(theta))
    return theta, value


def mixture(loglik: np.ndarray, text: np.ndarray, n: int, rounds: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """Proportions (n texts by languages) after selection; zero rows for texts without words.

    loglik: words by languages; text: the text of each word, ascending.
    """
    size = np.bincount(text, minlength=n)
    theta = np.zeros((n, loglik.shape[1]))
    theta[size > 0] = 1.0 / loglik.shape[1]
    which = np.flatnonzero(size)
    if not len(which):
        return theta
    like = np.exp(np.maximum(loglik - loglik.max(axis=1, keepdims=True), -60.0))
    theta, value = settle(theta, which, like, text, rounds, tolerance)
    penalty = 0.5 * np.log(np.maximum(size, 2))
    while True:
        which = which[(theta[which] > 0).sum(axis=1) > 1]
        if not len(which):
            return theta
        trial = theta.copy()
        smallest = np.where(theta[which] > 0, theta[which], np.inf).argmin(axis=1)
        trial[which, smallest] = 0
        trial[which] /= trial[which].sum(axis=1, keepdims=True)
        trial, score = settle(trial, which, like, text, rounds, tolerance)
        which = which[score[which] + penalty[which] >= value[which]]
        theta[which], value[which] = trial[which], score[which]


def learn(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", bits: int = 17) -> Model | None:
    """Models of all languages with a label, from rows that may be learned from."""
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count(bits), "lang string, size int, cell long, n long")
    table = counts.groupBy("lang", "size", "cell").agg(F.sum("n").alias("n"))
    # at most 2 ** bits rows per language and order, and no more than MOST_ROWS in all
    arrow = table.limit(MOST_ROWS + 1).toArrow()
    if arrow.num_rows > MOST_ROWS:
        raise ValueError("too many languages for one model: lower bits")
    if not arrow.num_rows:
        return None
    names = sorted(set(arrow.column("lang").to_pylist()))
    index = np.searchsorted(names, arrow.column("lang").to_numpy(zero_copy_only=False).astype(str))
    order, cell, n = (arrow.column(c).to_numpy() for c in ("size", "cell", "n"))
    tables = {}
    for o in ORDERS:
        pick = order == o
        count = np.zeros((1 << bits, len(names)))
        count[cell[pick], index[pick]] = n[pick]
        tables[o] = ((count + 0.01) / (count.sum(axis=0) + 0.01 * (1 << bits))).astype(np.float32)
    return Model(names, tables, bits)


def predicted(text: Column, model: Model | None) -> Column:
    """Struct (lang, score, languages): the language of greatest proportion, that proportion, and
    all selected ones with theirs. A text that is null or has no letter is `und` with score 0."""
    shape = "struct<lang:string,score:double,languages:map<string,double>>"
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,double>").alias("languages"))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])

    def judge(texts: list[str]) -> list[dict]:
        theta = mixture(*model.words(texts), len(texts))
        out = []
        for row in theta:
            chosen = [(model.languages[i], float(row[i])) for i in np.flatnonzero(row > 0)]
            best = max(chosen, key=lambda x: x[1], default=(UNKNOWN, 0.0))
            out.append({"lang": best[0], "score": min(1.0, best[1]), "languages": chosen})
        return out

    @F.arrow_udf(shape)
    def identify(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for text in byte_texts(texts):
            held.append(text.decode("utf-8", "replace"))
            size += len(text)
            if size > 2_000_000:  # bounds the arrays of one step
                out += judge(held)
                held, size = [], 0
        return pa.array(out + judge(held), type=kind)

    return identify(text)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row of docs; repeated rows stay."""
    model = learn(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.languages").alias("languages"))
