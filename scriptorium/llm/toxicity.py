"""Toxicity by weak supervision.

Voters, each a weak and noisy opinion on a document, are made first: groups of
seed words, groups of induced terms (whole words, and word beginnings of several
lengths, which catch inflections), and patterns of writing.  Terms are induced
from labelled rows, but a row is voted on only by terms that the other parts of
the rows gave, so no vote repeats the row's own label.  A generative label model
is fitted on the votes alone: expectation maximisation estimates what each voter
says for each class and, in each round, which voters are correlated beyond what
the classes explain; a voter counts the less the more others repeat it.  Labels
only orient the two classes and calibrate the posterior.  The posterior labels
then train a linear classifier on the presence of selected words and word
beginnings, of either class, which scores every text whole.

The fit uses at most MOST_TRAINING labelled documents, those with the least
hashes of their ids, and of each at most MOST_ROWS rows and MOST_TERMS terms;
everything that scores covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import textkit as tk
from scriptorium.llm import tokens
from scriptorium.llm.frames import in_arrow, map_arrow, materialise

#: Labelled rows that the model is fitted on, at most.
MOST_TRAINING = 10_000
#: Rows of one id and distinct terms of a row that the fit takes at most: those with the least hashes.
MOST_ROWS, MOST_TERMS = 4, 50_000
#: Parts of the training rows; groups of induced terms and words of a group of seeds, each a voter.
PARTS, GROUPS, SEEDS_OF_GROUP = 5, 24, 3
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: A term enters a lexicon with this log-likelihood ratio and precision, and the classifier with these: rarer terms,
#: and common words of a class' language, would add up to nonsense in long texts.
LEXICON_RATIO, LEXICON_PRECISION, FEATURE_RATIO, FEATURE_PRECISION = 16.0, 0.9, 16.0, 0.9
#: A beginning of which one word makes up more than this share is no term.
MOST_OF_ONE = 0.7

# Seed lexicons, common insults of four languages
SEEDS = {
    "en": "idiot moron stupid loser trash scum pathetic disgusting worthless clown dumb fool jerk garbage filthy vermin retard imbecile",
    "de": "idiot dummkopf blöd blödmann versager abschaum trottel widerlich wertlos depp arschloch",
    "fr": "idiot imbécile stupide crétin ordure minable débile abruti connard dégoûtant",
    "es": "idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso tonto",
}

_PATTERNS = ("shouting", "marks", "junk")
_lower: list[np.ndarray] = []


def _lower_table() -> np.ndarray:
    if not _lower:
        _lower.append(np.array([ord(y) if len(y := chr(c).lower()) == 1 else c for c in range(65536)], np.uint32))
    return _lower[0]


def _salt(kind: int) -> np.uint64:
    return np.uint64((0x51ED270B * (kind + 1)) & 0xFFFFFFFF)


def _terms(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool, np.ndarray]]:
    """(first row, next row, terms, rows, whether the rows end, pairs): hashes of words and their beginnings, kinds told apart, and of patterns.

    pairs: rows (row, beginning, word) of words and their beginnings.
    """
    for a, b in tk.row_slices(offsets):
        pieces = list(tk.word_chunks(raw, offsets, a, b))
        for i, (r, o) in enumerate(pieces):
            cp, pos = tk.code_points(r)
            low = _lower_table()[cp] if not len(cp) or cp.max() < 65536 else np.where(cp < 65536, _lower_table()[np.minimum(cp, 65535)], cp)
            letter = tokens.classes()[cp] == tokens._LETTER
            starts = np.searchsorted(pos, o, "left")
            edge = np.zeros(len(cp) + 1, bool)
            edge[1:-1] = letter[1:] != letter[:-1]
            edge[starts] = True
            mark = np.flatnonzero(edge)
            begin, end = mark[:-1], mark[1:]
            keep = letter[begin] if len(cp) else np.zeros(0, bool)
            begin, end = begin[keep], end[keep]
            h = tk.prefix_hash(low)
            row = np.searchsorted(starts, begin, "right") - 1
            parts, rows = [tk.segment_hash(h, begin, end) ^ _salt(0)], [row]
            pairs = [np.zeros((0, 3), np.uint64)]
            for k in BEGINNINGS:
                ok = end - begin >= k
                parts.append(tk.segment_hash(h, begin[ok], begin[ok] + k) ^ _salt(k))
                rows.append(row[ok])
                pairs.append(np.stack([row[ok].astype(np.uint64), parts[-1], parts[0][ok]], 1))
            n = len(o) - 1
            at = np.searchsorted(starts, np.arange(len(cp)), "right") - 1 if n > 1 else np.zeros(len(cp), np.int64)
            letters = np.bincount(at[letter], minlength=n)
            upper = np.bincount(at[letter & (low != cp)], minlength=n)
            marks = np.bincount(at[(cp == 33) | (cp == 63)], minlength=n)
            odd = np.bincount(at[np.isin(cp, (35, 36, 37, 38, 42, 64, 94))], minlength=n)
            for k, hit in enumerate((upper > 0.3 * letters, marks > 0.02 * letters + 1, odd > 0.1 * letters)):
                which = np.flatnonzero(hit & (letters > 0))
                parts.append(np.full(len(which), k + 1, np.uint64))
                rows.append(which)
            yield a, b, np.concatenate(parts), np.concatenate(rows), i == len(pieces) - 1, np.concatenate(pairs)


def _distinct(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    t, r = terms[order], rows[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    return t[new], r[new]


# ---- fitting ---------------------------------------------------------------


def _ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Signed log-likelihood ratio of terms' document counts by class."""
    n, share = toxic + clean, n_toxic / max(n_toxic + n_clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda o, e: np.where(o > 0, o * np.log(o / e), 0.0)
        g = 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))
    return np.where(toxic > n * share, g, -g)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30, tied_from: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, chance of a right vote per voter, weight per voter) of votes in {-1, 0, 1} [documents, voters].

    start: first posterior, only where the search for the classes begins.  Each
    round estimates the chance of each vote in each class from the posterior, then
    the voters' correlations given the classes: of what their votes differ by from
    what the classes let expect; a voter that agrees with others beyond tied_from
    is weighted by one over one and the sum of these correlations.
    """
    n, m = votes.shape
    spoken = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    q, weight = start.astype(float), np.ones(m)
    says = np.full((2, 3, m), 1 / 3)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 0.001, 0.999)
        for y, p in ((1, q), (0, 1 - q)):
            says[y] = (np.einsum("i,vij->vj", p, spoken) + 0.5) / (p.sum() + 1.5)
        rest = votes - (q[:, None] * (says[1, 2] - says[1, 0]) + (1 - q[:, None]) * (says[0, 2] - says[0, 0]))
        size = np.sqrt((rest * rest).sum(0) + 0.01 * n)
        tied = np.clip((rest.T @ rest) / np.outer(size, size), 0, 1)
        np.fill_diagonal(tied, 0)
        weight = 1 / (1 + np.where(tied > tied_from, tied, 0).sum(1))
        odds = np.log(says[1] / says[0]) * weight
        q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + np.einsum("vij,vj->i", spoken, odds), -40, 40)))
    right = (np.einsum("i,ij->j", q, spoken[2]) + np.einsum("i,ij->j", 1 - q, spoken[0]) + 0.5) / ((votes != 0).sum(0) + 1)
    return q, right, weight


def calibrated(q: np.ndarray, label: np.ndarray, steps: int = 25) -> np.ndarray:
    """Posteriors, turned round if they go against the labels, on the labels' scale: a logistic fit of two numbers."""
    if q[label == 1].mean() < q[label == 0].mean():
        q = 1 - q
    x = np.log(np.clip(q, 1e-6, 1 - 1e-6) / np.clip(1 - q, 1e-6, 1))
    a, b = 1.0, 0.0
    for _ in range(steps):  # Newton's, with a prior that holds the two near 1 and 0
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([x @ (p - label) + (a - 1), (p - label).sum() + b])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - step[0], 0.05), b - step[1]
    return 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))


def _logistic(row: np.ndarray, col: np.ndarray, n: int, width: int, target: np.ndarray, decay: float = 3e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence features with soft targets, by accelerated gradient steps."""
    w, v, bias = np.zeros(width), np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    vb = 0.0
    size = np.maximum(np.bincount(row, minlength=n), 1)
    rate = 4.0 / (np.percentile(size, 95) + 1)
    for _ in range(steps):
        z = np.bincount(row, w[col], n) + bias
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(col, err[row], width) / n + decay * w / 10
        v = 0.9 * v - 20 * rate * grad
        vb = 0.9 * vb - rate * err.mean()
        w, bias = w + v, bias + vb
    return w, bias


def _inflected(pairs: np.ndarray) -> np.ndarray:
    """Beginnings that stand for several words: of at least three, none in more than MOST_OF_ONE of the documents; pairs (beginning, word), once a document."""
    if not len(pairs):
        return np.zeros(0, np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    b, w = pairs[order, 0], pairs[order, 1]
    head = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])]))
    count = np.diff(np.append(head, len(b)))
    of = b[head]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    kinds = np.diff(np.append(first, len(of)))
    return of[first][(kinds >= 3) & (np.maximum.reduceat(count, first) <= MOST_OF_ONE * np.add.reduceat(count, first))]


def _fewest(terms: np.ndarray) -> np.ndarray:
    """At most MOST_TERMS of a row's terms, by their hashes' order, which has nothing to do with places in the text."""
    return terms if len(terms) <= MOST_TERMS else np.sort(terms[np.argpartition(tk.mix(terms), MOST_TERMS)[:MOST_TERMS]])


def fit(terms: list[np.ndarray], label: np.ndarray, part: np.ndarray, pairs: np.ndarray) -> dict:
    """The classifier from training documents' distinct terms, labels (0 or 1) and parts (0 to PARTS - 1); pairs: see _inflected, of the documents of label 1."""
    n = len(terms)
    sizes = np.array([len(t) for t in terms], np.int64)
    row = np.repeat(np.arange(n), sizes)
    vocabulary, col = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_inverse=True)
    width = len(vocabulary)
    if not n or label.min() == label.max():
        share = float(label.mean()) if n else 0.0
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": 4.0 if share > 0.5 else -4.0, "voters": 0, "training": n}
    # a beginning that one word makes up would only catch other words by accident
    whole = ~np.isin(vocabulary, pairs[:, 0]) | np.isin(vocabulary, _inflected(pairs))
    count = lambda pick: np.bincount(col[pick[row]], minlength=width).astype(float)
    group = (tk.mix(vocabulary) % np.uint64(GROUPS)).astype(np.int64)
    # a row's votes by induced terms: each part's rows by the terms of the others
    induced = np.zeros((n, GROUPS), np.int8)
    for k in range(PARTS):
        others = part != k
        toxic, clean = count(others & (label == 1)), count(others & (label == 0))
        g = _ratio(toxic, clean, (others & (label == 1)).sum(), (others & (label == 0)).sum())
        lexicon = whole & (g >= LEXICON_RATIO) & (toxic >= LEXICON_PRECISION * (toxic + clean))
        hit = lexicon[col] & ~others[row]
        induced[row[hit], group[col[hit]]] = 1
    votes = list(induced.T)

    def presence(chosen: np.ndarray) -> np.ndarray:
        hit = np.zeros(n, np.int8)
        hit[row[chosen[col]]] = 1
        return hit

    for words in SEEDS.values():
        each = words.split()
        for at in range(0, len(each), SEEDS_OF_GROUP):
            some = each[at : at + SEEDS_OF_GROUP]
            raw, offsets = tk.utf8(pa.array([" ".join(some)]))
            votes.append(presence(np.isin(vocabulary, next(_terms(raw, offsets))[2][: len(some)])))
    for k in range(len(_PATTERNS)):
        votes.append(presence(vocabulary == np.uint64(k + 1)))
    votes = np.stack(votes, 1).astype(float)
    votes = votes[:, votes.any(0)]
    if votes.shape[1]:
        q = label_model(votes, np.where(votes[:, : max(1, votes.shape[1] - len(_PATTERNS))].any(1), 0.9, 0.05))[0]
        q = calibrated(q, label)
    else:
        q = np.full(n, label.mean())
    toxic, clean = count(q >= 0.5), count(q < 0.5)
    g = _ratio(toxic, clean, (q >= 0.5).sum(), (q < 0.5).sum())
    bad = (g >= FEATURE_RATIO) & (toxic >= FEATURE_PRECISION * (toxic + clean))
    good = g <= -FEATURE_RATIO
    chosen = whole & (bad | good)
    place = np.cumsum(chosen) - 1
    use = chosen[col]
    w, bias = _logistic(row[use], place[col[use]], n, int(chosen.sum()), q)
    return {"keys": vocabulary[chosen], "weights": w, "bias": bias, "voters": votes.shape[1], "training": n}


# ---- Spark -----------------------------------------------------------------


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(key.cast("string")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The classifier, fitted in one task on a bounded sample; see the module."""
    known = labels.select(labels[key].cast("bigint").alias("id"), labels[label].cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(MOST_TRAINING)
    docs = documents.select(documents[key].cast("bigint").alias("id"), documents[text].cast("string").alias("text"))
    rows = docs.join(F.broadcast(known), "id").select("id", "y", "text")  # MOST_TRAINING rows of 12 bytes
    # an id that very many rows have must not fill the one fitting task; texts that are alike are one row
    rows = rows.groupBy("id", "y", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("h"))).filter(F.col("place") <= MOST_ROWS).select("id", "y", "text")

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = tk.utf8(batch.column(2))
        held: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        toxic, pairs = np.array(batch.column(1).to_pylist()) == 1, [b""] * batch.num_rows
        for a, b, terms, row, _, three in _terms(raw, offsets):
            three = np.unique(three[toxic[a:b][three[:, 0].astype(np.int64)]], axis=0)
            ends = np.searchsorted(three[:, 0], np.arange(b - a + 1))
            for k in np.flatnonzero(toxic[a:b]):
                pairs[a + k] += three[ends[k] : ends[k + 1], 1:].tobytes()
            terms, row = _distinct(terms, row)
            upto = np.searchsorted(row, np.arange(b - a + 1))
            for k in range(b - a):
                held[a + k].append(terms[upto[k] : upto[k + 1]])
        blobs = [_fewest(np.unique(np.concatenate(x)) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint64)).tobytes() for x in held]
        pairs = [np.unique(np.frombuffer(x, np.uint64).reshape(-1, 2), axis=0)[:MOST_TERMS].tobytes() for x in pairs]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(pairs, pa.binary())], names=["id", "y", "terms", "pairs"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, terms, pairs = [], [], [], [np.zeros((0, 2), np.uint64)]
        for batch in batches:
            pairs += [np.unique(np.frombuffer(x, np.uint64).reshape(-1, 2), axis=0) for x in batch.column(3).to_pylist() if x]
            ids += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            terms += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(terms[k])))
        ids = np.array(ids, np.int64)[order] if ids else np.zeros(0, np.int64)
        part = (tk.mix(ids.astype(np.uint64)) % np.uint64(PARTS)).astype(int)
        m = fit([terms[k] for k in order], np.array(ys, int)[order] if ys else np.zeros(0, int), part, np.concatenate(pairs))
        yield pa.record_batch([pa.array([m["keys"].tobytes()]), pa.array([m["weights"].astype("<f8").tobytes()]), pa.array([float(m["bias"])]), pa.array([m["voters"]], pa.int32()), pa.array([m["training"]])], names=["keys", "weights", "bias", "voters", "training"])

    gathered = map_arrow(rows, extract, "id bigint, y int, terms binary, pairs binary").repartition(1)
    got = in_arrow(gathered, learn, "keys binary, weights binary, bias double, voters int, training bigint").collect()
    if not got:
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -4.0, "voters": 0, "training": 0}
    r = got[0]
    return {"keys": np.frombuffer(r.keys, np.uint64), "weights": np.frombuffer(r.weights, "<f8"), "bias": r.bias, "voters": r.voters, "training": r.training}


def scored(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score, predicted) of every row, from its whole text; a null or empty text has the score of no evidence."""
    keys, weights, bias = model["keys"], model["weights"], model["bias"]
    names = [key, *keep]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = tk.HashTable(max(8, int(len(keys)).bit_length() + 1))
        table.add(keys, np.arange(len(keys), dtype=np.int32))
        raw, offsets = tk.utf8(batch.column(batch.num_columns - 1))
        z = np.full(batch.num_rows, bias)
        open_: list[np.ndarray] = []
        for a, b, terms, row, done, _ in _terms(raw, offsets):
            hit = table.find(terms)
            found = hit >= 0
            if not done or open_:  # a long text comes in parts, but a term counts once
                open_.append(np.unique(hit[found]))
                if done:
                    z[a] += weights[np.unique(np.concatenate(open_))].sum()
                    open_ = []
                continue
            pair = np.unique(row[found] * len(keys) + hit[found])
            z[a:b] += np.bincount(pair // max(len(keys), 1), weights[pair % max(len(keys), 1)], b - a) if len(pair) else 0.0
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pa.record_batch([*(batch.column(k) for k in range(len(names))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[f"c{k}" for k in range(len(names))] + ["score", "predicted"])

    chosen = df.select(*[df[c].alias(f"c{k}") for k, c in enumerate(names)], df[text].cast("string").alias("t"))
    kinds = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    out = map_arrow(chosen, run, f"{kinds}, score double, predicted int")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "score", "predicted")


def toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of documents.

    Rows of one key are scored each by its own text; a null key is not held out
    and never trains; without labels of both classes every score tells the
    share of the one seen, or is low; other columns play no part.
    """
    out = scored(documents, train(documents, labels, key, text), key, text)
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", "predicted")
