"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are lower-case pre-tokens. Their tags come from document labels: in a toxic training document, a token is tagged
if its word or one of its beginnings is much more frequent in toxic than in clean training documents (a likelihood-ratio
test). Sequences are sentences; those without any word that has a weight differ in length only, so each length is
computed once. The field is trained on these tagged sequences by maximum likelihood, with forward-backward for the gradient.
A document's score is a logistic function of its tokens' marginals (their largest, and the expected number of toxic
tokens); offending offsets are the runs of tokens with a marginal of one half or more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import fresh, slices, text_column, text_groups, text_key, written

#: Labelled training texts of each class that the model is fitted on (those with the smallest hashes), and the bytes of the
#: longest one, so at most 2 * SAMPLE * LONGEST bytes reach the driver. All texts are scored, whatever their length.
SAMPLE, LONGEST = 1500, 1 << 15
#: Beginnings of words that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Least likelihood-ratio statistic, beside twice the logarithm of the number of features, and least ratio of rates.
EVIDENCE, RATIO = 10.0, 3.0
#: Rounds of training and the penalty on squared weights.
ROUNDS, SHRINK = 50, 1e-4
#: Tokens whose transitions are multiplied one after another; blocks advance together.
BLOCK = 256


def plain_lower(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def features(word: str) -> list[str]:
    return [word + "$", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


@dataclass
class Field:
    """Start and transition weights, the bias of the toxic state and the weights of features for it."""

    start: np.ndarray
    step: np.ndarray
    weights: dict[str, float]
    document: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Weights of words; most words share no beginning with any feature and need no more than a look."""
        get, first = self.weights.get, {f.rstrip("$")[: BEGINNINGS[0]] for f in self.weights}
        return np.array([sum(get(f, 0.0) for f in features(w)) if w[: BEGINNINGS[0]] in first else 0.0 for w in words])

    def marginals(self, scores: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Marginals of the toxic state of all tokens."""
        out = np.zeros(len(scores))
        if not len(scores):
            return out
        sizes = np.diff(np.append(heads, len(scores)))
        marked = np.logical_or.reduceat(scores != 0, heads)
        at = np.flatnonzero(np.repeat(marked, sizes))
        if len(at):
            own = sizes[marked]
            out[at] = forward_backward(scores[at], np.cumsum(own) - own, self.start, self.step)[0]
        plain = np.flatnonzero(~marked)
        if len(plain):
            lengths, kind = np.unique(sizes[plain], return_inverse=True)
            first = np.cumsum(lengths) - lengths
            one = forward_backward(np.zeros(int(lengths.sum())), first, self.start, self.step)[0]
            n = sizes[plain]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(heads[plain], n) + inner] = one[np.repeat(first[kind], n) + inner]
        return out


def forward_backward(scores: np.ndarray, heads: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of the toxic state, and (if asked for) those of each transition into a token that is no head.

    All sequences lie in one array; heads are their first tokens. A head's transition does not depend on the state
    before it, so blocks of tokens need no regard for where sequences begin.
    """
    n = len(scores)
    blocks = -(-n // BLOCK)
    m = np.zeros((blocks * BLOCK, 2, 2))
    m[n:, 0, 0] = m[n:, 1, 1] = 1
    m[:n] = np.exp(step)
    m[heads] = np.exp(start)
    m[:n, :, 1] *= np.exp(np.clip(scores, -30, 30))[:, None]
    m = m.reshape(blocks, BLOCK, 2, 2)
    product = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for t in range(BLOCK):
        product = product @ m[:, t]
        product /= product.sum(axis=(1, 2), keepdims=True)
    first, last = np.empty((blocks, 2)), np.empty((blocks, 2))
    a, b = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    for k in range(blocks):
        first[k] = a
        a = a @ product[k]
        a = a / a.sum()
        last[blocks - 1 - k] = b
        b = product[blocks - 1 - k] @ b
        b = b / b.sum()
    alpha, beta = np.empty((blocks, BLOCK, 2)), np.empty((blocks, BLOCK, 2))
    a, b = first, last
    for t in range(BLOCK):
        a = np.einsum("ki,kij->kj", a, m[:, t])
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
        back = BLOCK - 1 - t
        beta[:, back] = b
        b = np.einsum("kij,kj->ki", m[:, back], b)
        b = b / b.sum(axis=1, keepdims=True)
    both = (alpha * beta).reshape(-1, 2)[:n]
    marginal = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return marginal, None
    before = np.concatenate([np.full((1, 2), 0.5), alpha.reshape(-1, 2)])[:n]
    xi = before[:, :, None] * m.reshape(-1, 2, 2)[:n] * beta.reshape(-1, 2)[:n, None, :]
    return marginal, xi / xi.sum(axis=(1, 2), keepdims=True)


def tokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different words, which stands at each token, the text of each token, and its start and end in its text."""
    points, bounds = pretokens.codes([plain_lower(t) for t in texts])
    starts, ends, owner = pretokens.cut(points, bounds, keep_spaces=False)
    words, place = pretokens.distinct(points, starts, ends)
    return words, place, owner, starts - bounds[owner], ends - bounds[owner]


def heads_of(owner: np.ndarray, place: np.ndarray, words: list[str]) -> np.ndarray:
    """The first token of each sentence: a text's first, and those behind a mark that ends with . ! or ?"""
    if not len(owner):
        return np.zeros(0, np.int64)
    ending = np.array([w[-1] in ".!?" for w in words], bool)[place[:-1]]
    return np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | ending))


def gathered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, which stands at each token, and the text of each token, of texts taken a few at a time."""
    index: dict[str, int] = {}
    places, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a, b in slices(np.array([len(t) for t in texts], np.int64)):
        words, place, owner, _, _ = tokens(texts[a:b])
        number = np.array([index.setdefault(w, len(index)) for w in words], np.int32)
        places.append(number[place])
        owners.append((owner + a).astype(np.int32))
    return list(index), np.concatenate(places), np.concatenate(owners)


def tagging_features(words: list[str], place: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> set[str]:
    """Features of toxic documents that mark them, by a likelihood-ratio test on document counts."""
    pairs = np.unique(owner.astype(np.int64) * len(words) + place)
    texts, own = pairs // max(1, len(words)), pairs % max(1, len(words))
    cuts = np.flatnonzero(np.append(True, texts[1:] != texts[:-1])) if len(texts) else np.zeros(0, np.int64)
    runs = [(bool(toxic[texts[a]]), a, b) for a, b in zip(cuts, np.append(cuts[1:], len(texts)))]
    bad, good = Counter(), Counter()
    for t, a, b in runs:
        if t:
            bad.update({f for w in own[a:b].tolist() for f in features(words[w])})
    for t, a, b in runs:
        if not t:
            good.update({f for w in own[a:b].tolist() for f in features(words[w]) if f in bad})
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return set()
    need = 2 * np.log(max(2, len(bad))) + EVIDENCE
    out = set()
    for f, a in bad.items():
        b = good.get(f, 0)
        if a / n1 < RATIO * b / n0:
            continue
        e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        if 2 * (a * np.log(a / e1) + (b * np.log(b / e0) if b else 0)) >= need:
            out.add(f)
    return out


def document_inputs(marginal: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """The inputs of the document score: 1, the largest marginal and the logarithm of the expected toxic tokens."""
    out = np.zeros((n_texts, 3))
    out[:, 0] = 1
    if len(owner):
        np.maximum.at(out[:, 1], owner, marginal)
        out[:, 2] = np.log1p(np.bincount(owner, weights=marginal, minlength=n_texts))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fitted(texts: list[str], toxic: np.ndarray, totals: tuple[int, int]) -> Field:
    """A field trained on labelled texts; totals are the numbers of clean and toxic labels the texts are drawn from.

    Equal texts count once, so that groups of copies are no evidence.
    """
    once = dict(zip(texts, toxic.tolist()))
    texts, toxic = list(once), np.array(list(once.values()), bool)
    words, place, owner = gathered(texts)
    marks = tagging_features(words, place, owner, toxic)
    word_marks = [[f for f in features(w) if f in marks] for w in words]
    tagged_word = np.array([bool(m) for m in word_marks], bool)
    tag = (tagged_word[place] & toxic[owner]).astype(np.float64) if len(place) else np.zeros(0)
    names = sorted({f for m in word_marks for f in m})
    index = {f: i for i, f in enumerate(names)}
    pair = np.array([(w, index[f]) for w, m in enumerate(word_marks) for f in m], np.int64).reshape(-1, 2)
    # sentences without a marked word count by their lengths
    heads = heads_of(owner, place, words)
    sizes = np.diff(np.append(heads, len(place)))
    marked = np.logical_or.reduceat(tagged_word[place], heads) if len(heads) else np.zeros(0, bool)
    lengths, times = np.unique(sizes[~marked], return_counts=True)
    at = np.flatnonzero(np.repeat(marked, sizes))
    token = np.concatenate([place[at], np.full(int(lengths.sum()), len(words))]).astype(np.int64)
    tag = np.concatenate([tag[at], np.zeros(int(lengths.sum()))])
    sizes = np.concatenate([sizes[marked], lengths])
    weight = np.repeat(np.concatenate([np.ones(int(marked.sum())), times]), sizes)
    heads = np.cumsum(sizes) - sizes
    inner = np.ones(len(token), bool)
    inner[heads] = False

    def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([0.0, x[0]]), np.array([[0.0, x[1]], [0.0, x[2]]]), x[3:]

    x = np.concatenate([[-3.0, -4.0, -2.0], np.zeros(len(names))])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    if len(names):
        before = np.append(0.0, tag[:-1])
        wanted = np.array([(weight * tag)[heads].sum(), (weight * tag * (1 - before))[inner].sum(), (weight * tag * before)[inner].sum()])
        for t in range(1, ROUNDS + 1):
            start, step, w = unpack(x)
            score = np.append(np.bincount(pair[:, 0], weights=w[pair[:, 1]], minlength=len(words)), 0.0)
            marginal, xi = forward_backward(score[token], heads, start, step, pairs=True)
            seen = np.array([(weight * marginal)[heads].sum(), (weight * xi[:, 0, 1])[inner].sum(), (weight * xi[:, 1, 1])[inner].sum()])
            gap = np.bincount(token, weights=weight * (tag - marginal), minlength=len(words) + 1)
            rise = np.concatenate([wanted - seen, np.bincount(pair[:, 1], weights=gap[pair[:, 0]], minlength=len(names))])
            rise = rise / max(1.0, tag.sum()) - SHRINK * x
            mean, square = 0.9 * mean + 0.1 * rise, 0.99 * square + 0.01 * rise * rise
            x = x + 0.3 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    start, step, w = unpack(x)
    field = Field(start, step, dict(zip(names, w.tolist())), np.zeros(3))
    marginal = field.marginals(field.word_scores(words)[place], heads_of(owner, place, words)) if len(place) else np.zeros(0)
    inputs = document_inputs(marginal, owner, len(texts))
    y = toxic.astype(np.float64)
    share = np.where(toxic, (totals[1] + 1) / (toxic.sum() + 1), (totals[0] + 1) / ((~toxic).sum() + 1))
    share = share * len(texts) / share.sum() if len(texts) else share
    d = np.zeros(3)
    for _ in range(30):  # Newton steps on the weighted logistic likelihood
        p = sigmoid(inputs @ d)
        slope = inputs.T @ (share * (y - p)) - 0.1 * d
        bend = (inputs * (share * p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(3)
        d = d + np.linalg.solve(bend, slope)
    field.document = d
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """The field fitted on at most SAMPLE different labelled texts of each class, none of a held-out row.

    Documents without a label, labels without a document and null labels are passed over, copies of a text count once, and
    a text that is labelled both ways is toxic. With one class only (or none), every score is the share of toxic labels.
    """
    text = text_column(text_col)
    k1, k2 = text_key(text)
    said = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    said = said.where("toxic IN (0, 1) AND id IS NOT NULL").where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), F.octet_length(text).alias("size"))
    known = written(keyed.join(said, "id").groupBy("k1", "k2").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    few = None
    for kind in (0, 1):
        own = known.where((F.col("toxic") == kind) & (F.col("size") <= LONGEST)).orderBy("k1", "k2").limit(SAMPLE)
        few = own if few is None else few.unionByName(own)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).join(F.broadcast(few.select("k1", "k2", "toxic")), ["k1", "k2"])  # 2 * SAMPLE rows are broadcast
    rows = texts.groupBy("k1", "k2", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values(["k1", "k2"])
    return fitted(rows["text"].tolist(), rows["toxic"].to_numpy() == 1, (counts.get(0, 0), counts.get(1, 0)))


def with_scores(docs: DataFrame, field: Field, text_col: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """docs with a score and the offending spans (offsets in characters); the columns of docs stay as they are.

    Every row is scored by its whole text alone; a null or empty text gets the score of a document without toxic
    tokens. score and spans name the new columns; docs must not have them. An empty table gives no rows.
    """
    if {score.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {score} or {spans} already: name the new ones otherwise")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for part in text_groups(batch, text_col):
                texts = [t or "" for t in part.column(at).to_pylist()]
                words, place, owner, starts, ends = tokens(texts)
                marginal = field.marginals(field.word_scores(words)[place], heads_of(owner, place, words)) if len(place) else np.zeros(0)
                value = sigmoid(document_inputs(marginal, owner, len(texts)) @ field.document)
                found: list[list[dict]] = [[] for _ in texts]
                for i in np.flatnonzero(marginal >= 0.5).tolist():
                    own, begin = found[owner[i]], int(starts[i])
                    if own and i and owner[i - 1] == owner[i] and own[-1]["stop"] == int(ends[i - 1]):
                        own[-1]["stop"] = int(ends[i])
                    else:
                        own.append({"start": begin, "stop": int(ends[i])})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array(found, span)], names=[*batch.schema.names, score, spans])

    schema = T.StructType(docs.schema.fields + [T.StructField(score, T.DoubleType()), T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, spans), one for each row of docs.

    Null and empty texts are scored like others; a null id is not held out; repeated rows are scored each. Extra columns
    are ignored, whatever their names; an empty table gives no rows. See train() for labels that are missing or at odds.
    """
    field = train(docs, labels, id_col, text_col)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return with_scores(picked, field).select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below one half, with their columns, whatever their names."""
    score, spans = fresh(docs, 2)
    return with_scores(docs, train(docs, labels, id_col, text_col), text_col, score, spans).where(F.col(score) < 0.5).select(*docs.columns)
