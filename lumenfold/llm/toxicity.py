"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, build
from .common import discard, hashed_sample, materialize, ship

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows whose texts induce the lexicons and train the classifier, at most.
SAMPLE = 20_000
#: Terms kept, and lexicon voters that their families are dealt to.
TERMS, VOTERS = 2_000, 24
PREFIXES = (4, 5, 6)
#: Words and beginnings with the same first letters are one family.
FAMILY = 4
#: Shares of a text's words from which on a family may tell; the labelled sample picks one for each family.
CUTS = (0.0, 1 / 1000, 1 / 500, 1 / 300, 1 / 200, 1 / 150, 1 / 100, 1 / 75, 1 / 50, 1 / 30)
#: Words of address, for the voter that looks for them beside evidence.
ADDRESS = frozenset("you your yours du dich dir dein ihr euch tu toi te ton vous votre tú ti usted vos vosotros".split())
#: Pattern voters, in this order after the lexicon voters. The last two speak for a clean text.
PATTERNS = ("dense", "clustered", "addressed", "manifold", "repeated", "exclaimed", "dilute", "silent")
CLEAN = 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def terms_of(word: str) -> Iterator[str]:
    """A word is evidence as itself and by its beginnings, written with a star."""
    yield word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n] + "*"


def _term_counts():
    """Of batches (text, toxic, copies): on how many clean and toxic texts a term is, and on how many toxic rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
        for batch in batches:
            for text, toxic, copies in zip(*batch.columns, strict=True):
                found = {t for w in set(WORDS.findall((text.as_py() or "").lower())) for t in terms_of(w)}
                counts[toxic.as_py()].update(found)
                if toxic.as_py() and copies.as_py() > 1:
                    counts[2].update(dict.fromkeys(found, copies.as_py() - 1))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in counts]], ["term", "clean", "toxic", "repeats"])

    return run


def _hits(terms: list[str]):
    """Every document's term numbers, in order of occurrence counts, with its number of words."""
    known = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            rows, counts, sizes = [], [], []
            for text in batch.column(1):
                words = WORDS.findall((text.as_py() or "").lower())
                found: Counter = Counter()
                for w in words:
                    at = cache.get(w)
                    if at is None:
                        if len(cache) > 120_000:
                            cache.clear()
                        at = cache[w] = tuple(known[t] for t in terms_of(w) if t in known)
                    if at:
                        found.update(at)
                keys = sorted(found)
                rows.append(keys), counts.append([found[k] for k in keys]), sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], ["id", "terms", "counts", "n_words"])

    return run


def telling(toxic: int, clean: int, prior: float, least: int) -> bool:
    """Whether more of a term's texts are toxic than not, and chance gives that as rarely as `least` toxic ones and no clean one.

    By Chernoff's bound on the binomial tail. How much such a term is worth, the label model estimates.
    """
    if toxic <= clean:
        return False
    p = toxic / (toxic + clean)
    divergence = p * np.log(p / prior) + ((1 - p) * np.log((1 - p) / (1 - prior)) if p < 1 else 0.0)
    return bool((toxic + clean) * divergence >= least * -np.log(prior))


def distinct_texts(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, copies): labelled texts once each, toxic if most of their rows are; `sample` of them at most, picked by hash."""
    texts = materialize(rows.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"), F.count("*").alias("copies")), "texts")
    count = texts.count()
    return texts if count <= sample else materialize(hashed_sample(texts, "text", sample, count), "texts")


def induce_terms(rows: DataFrame) -> list[str]:
    """See induced()."""
    return induced(rows)[0]


def induced(rows: DataFrame) -> tuple[list[str], int]:
    """Words and beginnings that speak for a toxic text more than against it, best first; and how many families the texts have.

    rows: (text, toxic). Equal texts count once, so a group of copies has one text's say. A term needs more toxic texts
    than chance would give some term of the vocabulary.
    A beginning that clean texts have more often than a longer term must add enough toxic texts to that one's.
    Terms that nearly always occur together with several others are a passage of near copies, unless the texts that
    have them without half of the passage suffice. A text with enough toxic rows, but none of these terms, adds its
    best one.
    """
    texts = rows if "copies" in rows.columns else distinct_texts(rows)
    counted = materialize(texts.select("text", "toxic", "copies").mapInArrow(_term_counts(), "term string, clean bigint, toxic bigint, repeats bigint").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "repeats")]), "terms")
    share = texts.agg(F.avg("toxic")).first()
    among = counted.where(F.length("term") == FAMILY + 1).where(F.col("term").endswith("*")).count()
    prior = min(0.5, max(1e-3, share[0] or 1e-3))
    size = counted.count()
    least = max(3, int(np.ceil(np.log(max(size, 2)) / -np.log(prior))) - 3)
    evident = lambda toxic, clean: toxic >= least and telling(toxic, clean, prior, least)
    found = counted.where(F.col("toxic") + F.col("repeats") >= least).where(F.col("toxic") + F.col("repeats") > F.col("clean")).orderBy(F.desc("toxic"), F.desc("repeats"), "term").collect()
    discard(counted)
    # a term that only rows of copies speak for is there for texts which have no other
    rows = [r for r in found if evident(r["toxic"] + r["repeats"], r["clean"])]
    terms = [r["term"] for r in rows]
    if not terms:
        return [], 0
    toxic = texts.where("toxic = 1").select(F.col("copies").alias("id"), "text").mapInArrow(_hits(terms), "id bigint, terms array<int>, counts array<int>, n_words bigint").select("id", "terms").toLocalIterator()
    have = [(r["id"], np.array(r["terms"], dtype=np.int64)) for r in toxic if r["terms"]]
    seen: list[list[int]] = [[] for _ in terms]
    for n, (_, own) in enumerate(have):
        for t in own:
            seen[t].append(n)
    times = np.array([len(x) for x in seen])
    roots = np.unique([t[:4] for t in terms], return_inverse=True)[1]
    alone = np.array([evident(r["toxic"], r["clean"]) for r in rows])
    # a beginning is judged on the texts that it adds to those of its longer, cleaner kin
    kin: dict[int, list[int]] = {}
    for i in np.flatnonzero(alone):
        kin.setdefault(roots[i], []).append(i)
    for i in [i for i in np.flatnonzero(alone) if terms[i][-1] == "*" and rows[i]["clean"]]:
        cleaner = [j for j in kin[roots[i]] if j != i and terms[j].startswith(terms[i][:-1]) and rows[j]["clean"] < rows[i]["clean"]]
        if cleaner:
            more = set(seen[i]).difference(*[seen[j] for j in cleaner])
            alone[i] = evident(len(more), rows[i]["clean"] - max(rows[j]["clean"] for j in cleaner))
    keep = np.zeros(len(terms), dtype=bool)
    for i in np.flatnonzero(alone):
        own = np.concatenate([have[n][1] for n in seen[i]])
        both = np.bincount(own, minlength=len(terms))
        together = alone & (roots != roots[i]) & (both > 0.6 * (times[i] + times - both))
        if together.sum() < 4:
            keep[i] = True
            continue
        apart = sum(1 for n in seen[i] if 2 * together[have[n][1]].sum() < together.sum())
        keep[i] = evident(apart, rows[i]["clean"])
    for copies, own in sorted(have, key=lambda x: (-x[0], x[1].tolist())):
        if copies >= least and not keep[own].any():
            best = min(own, key=lambda t: (-rows[t]["toxic"] - rows[t]["repeats"] + rows[t]["clean"], terms[t]))
            keep[best] = True
    return [terms[i] for i in np.flatnonzero(keep)][:TERMS], among


def _evidence(terms: list[str]):
    """Each text's families with counts of words, its number of words and its marks: words of evidence within 20 words of the last one, those with a word of address within three words, and exclamation marks.

    Batches are (id, text); the id is kept.
    """
    names = families(terms)
    known, family = set(terms), {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            rows, counts, sizes, marks = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                words = WORDS.findall(text.lower())
                found: Counter = Counter()
                near = addressed = 0
                last = -100
                for i, w in enumerate(words):
                    at = cache.get(w)
                    if at is None:
                        if len(cache) > 120_000:
                            cache.clear()
                        at = cache[w] = family[w[:FAMILY]] if any(t in known for t in terms_of(w)) else -1
                    if at >= 0:
                        found[at] += 1
                        near += i - last <= 20
                        addressed += not ADDRESS.isdisjoint(words[max(0, i - 3) : i + 4])
                        last = i
                keys = sorted(found)
                rows.append(keys), counts.append([found[k] for k in keys]), sizes.append(len(words)), marks.append([near, addressed, text.count("!")])
            made = [pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [batch.schema.names[0], *EVIDENCE])

    return run


EVIDENCE = ("_families", "_counts", "_words", "_marks")
EVIDENCE_SCHEMA = "_families array<int>, _counts array<int>, _words bigint, _marks array<int>"


def families(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t[:FAMILY] for t in terms))


def family_cuts(evidence: list[tuple], toxic: np.ndarray, n_families: int, among: int) -> np.ndarray:
    """For each family the share of a text's words from which on it tells most about the labels: texts with it times the divergence of their toxic share from the prior.

    Infinite for a family that tells no more than the best of `among` families might by chance.
    """
    prior = float(np.clip(toxic.mean(), 1e-3, 0.5))
    seen: list[list[tuple]] = [[] for _ in range(n_families)]
    for (fams, counts, words, _), y in zip(evidence, toxic, strict=True):
        for f, c in zip(fams, counts, strict=True):
            seen[f].append((c / max(words, 1), y))
    out = np.full(n_families, np.inf)
    for f, rows in enumerate(seen):
        best = np.log(max(among, 2)) - 1
        for cut in CUTS:
            above = [y for r, y in rows if r >= cut]
            if not above:
                break
            p = min(float(np.mean(above)), 1 - 1e-9)
            told = len(above) * (p * np.log(p / prior) + (1 - p) * np.log((1 - p) / (1 - prior))) if p > prior else 0.0
            if told > best * 1.02:
                best, out[f] = told, cut
    return out


@dataclass
class Voters:
    """Lexicon voters, to whom families are dealt, and the patterns. Of batches of evidence they make votes and the classifier's inputs."""

    cuts: np.ndarray
    dealt: np.ndarray
    lexicons: int

    @classmethod
    def of(cls, cuts: np.ndarray, lexicons: int) -> Voters:
        dealt = np.arange(len(cuts)) % lexicons
        return cls(cuts, dealt, min(lexicons, len(cuts)))

    @property
    def size(self) -> int:
        return self.lexicons + len(PATTERNS)

    def look(self, evidence: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(votes, inputs): a family counts where its share of the text's words reaches its cut."""
        votes = np.zeros((len(evidence), self.size))
        x = np.zeros((len(evidence), 8 + len(self.cuts)), dtype=np.float32)
        for i, (fams, counts, words, (near, addressed, exclaimed)) in enumerate(evidence):
            x[i, 0] = 1
            if not fams:
                votes[i, -1] = 1
                continue
            words = max(words, 1)
            passing = [(f, c) for f, c in zip(fams, counts, strict=True) if c / words >= self.cuts[f]]
            total = sum(c for _, c in passing)
            for f, _ in passing:
                votes[i, self.dealt[f]] = 1
                x[i, 8 + f] = 1
            some = bool(passing)
            votes[i, self.lexicons :] = (total / words >= 1 / 150, some and near > 0, some and addressed > 0, len(passing) > 1, some and max(c for _, c in passing) > 2, some and exclaimed > 0, not some or sum(counts) / words < 1 / 500, not some)
            x[i, 1:8] = some, len(passing) > 1, np.log1p(total), min(3.0, 50 * total / words), some and near > 0, some and addressed > 0, not some
        return votes, x


@dataclass
class LabelModel:
    """Conditionally independent voters, but for the correlated ones, which share their weight. The last CLEAN voters vote for a clean text."""

    prior: float
    given_toxic: np.ndarray
    given_clean: np.ndarray
    share: np.ndarray
    clean_voters: int = 0

    @classmethod
    def fit(cls, n: float, ones: np.ndarray, both: np.ndarray, prior: float, clean_rate: np.ndarray, clean_voters: int = 0) -> LabelModel:
        """From how often each voter, and each two, voted over all documents.

        Cov(i, j) = prior * (1 - prior) * d_i * d_j for independent voters, with d the difference of a voter's rates
        on toxic and clean texts; three voters give d_i^2, and the median over pairs is robust to dependent ones.
        What two covary beyond that is their correlation. `clean_rate`, the votes on texts labelled clean, anchors
        the level of the rates, which moments alone leave to the class share. Of a voter for clean texts the absence of its
        vote is what varies with toxicity, so its indicator is turned round first.
        """
        m, mean = len(ones), ones / max(n, 1)
        cov = both / max(n, 1) - np.outer(mean, mean)
        turned = np.arange(m) >= m - clean_voters
        sign = np.where(turned, -1.0, 1.0)
        cov, mean, clean_rate = cov * np.outer(sign, sign), np.where(turned, 1 - mean, mean), np.where(turned, 1 - clean_rate, clean_rate)
        scale = prior * (1 - prior)
        d = np.zeros(m)
        for i in range(m):
            found = [cov[i, j] * cov[i, k] / cov[j, k] for j in range(m) for k in range(j + 1, m) if i not in (j, k) and cov[j, k] > 1e-9 and cov[i, j] > 0 and cov[i, k] > 0]
            d[i] = np.sqrt(np.median(found) / scale) if found else (mean[i] / prior if prior else 0)
        d = np.clip(d, 0, np.minimum(1, mean / max(prior, 1e-9)))
        clean = np.clip(np.minimum(mean - prior * d, clean_rate), 1e-5, np.where(turned, 1 - 1e-4, 0.5))
        toxic = np.clip(np.maximum(clean + d, (mean - (1 - prior) * clean) / prior), np.minimum(clean * 1.01, 1 - 1e-4), 1 - 1e-4)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        beyond = (cov - scale * np.outer(d, d)) / np.outer(sd, sd)
        np.fill_diagonal(beyond, 0)
        return cls(prior, toxic, clean, 1 / (1 + np.clip(beyond, 0, 1).sum(axis=1)), clean_voters)

    def posterior(self, votes: np.ndarray, silent: float) -> np.ndarray:
        """A voter without evidence abstains; where none votes for toxic, the answer is `silent`, the share of toxic texts among such.

        Of a text's votes for toxic the strongest counts in full, the others as far as they are independent; so do
        votes for clean.
        """
        m = len(self.given_toxic) - self.clean_voters
        yes = np.log(self.given_toxic / self.given_clean)
        no = np.log((1 - self.given_toxic[m:]) / (1 - self.given_clean[m:]))
        for_, against = votes[:, :m], votes[:, m:]
        full = (for_ * yes[:m]).max(axis=1, initial=0.0)
        shared = for_ @ (yes * self.share)[:m] - (for_ * (yes * self.share)[:m]).max(axis=1, initial=0.0)
        odds = np.log(self.prior / (1 - self.prior)) + full + shared + (against * no * self.share[m:]).sum(axis=1)
        return np.where(for_.any(axis=1), 1 / (1 + np.exp(-np.clip(odds, -40, 40))), silent)


def _moments(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((voters.size, voters.size))
        for batch in batches:
            v, _ = voters.look(_rows(batch))
            n, total = n + len(v), total + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])

    return run


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    """The evidence of a batch's last four columns, row by row."""
    return list(zip(*[c.to_pylist() for c in batch.columns[-4:]], strict=True))


def train_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 2000) -> np.ndarray:
    """Logistic regression on soft labels of weighted rows, by Nesterov's gradient steps."""
    x = x.astype(np.float64)
    weight = weight / weight.sum()
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 4.0 / max(1e-9, float(weight @ (x * x).sum(axis=1)))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        new = v - rate * (x.T @ (weight * (p - y)) + ridge * np.r_[0, v[1:]])
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class ToxicityModel:
    """What scoring needs: the terms, the voters and the linear model's weights; no weights if there was nothing to learn."""

    terms: list[str]
    voters: Voters | None = None
    weights: np.ndarray | None = None
    labels: LabelModel | None = None

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = []
        for s in range(0, batch.num_rows, 2048):
            z = self.voters.look(_rows(batch.slice(s, 2048)))[1] @ self.weights
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out) if out else np.empty(0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, training: Column | None = None, key: Column | None = None) -> tuple[ToxicityModel, DataFrame | None]:
    """The model, and every row's key (`_key`, its id unless another is given) with its evidence, written in one pass over the texts.

    Labels of rows outside the held-out fold (or where `training` holds, over columns id and toxic) alone are learnt
    from: `sample` ids and `sample` distinct texts at most, picked by hash. They induce words and word beginnings; the
    share of a text's words from which on a family of these tells; and the share of toxic texts. Families are dealt
    to lexicon voters; pattern voters look at how dense, clustered, manifold or repeated the evidence is, and whom it
    addresses; two speak for a clean text. All documents' votes give the moments from which the label model takes the
    voters' accuracies and correlations; its posteriors on the sample train the linear classifier.
    Conflicting labels of one id: toxic. Labels other than 0 and 1, and of null ids, are left out.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    marked = labels.select(labels[id_col].cast(kind).alias("id"), labels[label_col].alias("toxic"))
    marked = marked.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out(F.col("id")) if training is None else training)
    # `sample` rows at most, so they can be broadcast
    chosen = F.broadcast(hashed_sample(marked.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")), "id", sample))
    texts = distinct_texts(named.join(chosen, "id").select("text", "toxic"), sample)
    terms, among = induced(texts)
    if not terms:
        return ToxicityModel([]), None
    # `sample` rows at most
    learnt = texts.select("toxic", "text").mapInArrow(_evidence(terms), f"toxic int, {EVIDENCE_SCHEMA}").toPandas()
    evidence = [(list(map(int, f)), list(map(int, c)), int(w), list(map(int, m))) for f, c, w, m in learnt[list(EVIDENCE)].itertuples(index=False)]
    discard(texts)
    toxic = learnt["toxic"].to_numpy()
    cuts = family_cuts(evidence, toxic, len(families(terms)), among)
    if np.isinf(cuts).all():
        return ToxicityModel([]), None
    names = [f for f, c in zip(families(terms), cuts, strict=True) if np.isfinite(c)]
    terms, chosen_families = [t for t in terms if t[:FAMILY] in set(names)], np.cumsum(np.isfinite(cuts)) - 1
    evidence = [([int(chosen_families[f]) for f in fams if np.isfinite(cuts[f])], [c for f, c in zip(fams, counts, strict=True) if np.isfinite(cuts[f])], words, marks) for fams, counts, words, marks in evidence]
    voters = Voters.of(cuts[np.isfinite(cuts)], VOTERS)
    keyed = docs.select((docs[id_col] if key is None else key).alias("_key"), docs[text_col].cast("string").alias("_text"))
    table = materialize(keyed.mapInArrow(_evidence(terms), f"_key {keyed.schema['_key'].dataType.simpleString()}, {EVIDENCE_SCHEMA}"), "evidence")
    n, both = 0, np.zeros((voters.size, voters.size))
    # a row for each task, of fixed size, summed before the driver sees one
    summed = table.select(*EVIDENCE).mapInArrow(_moments(voters), "n bigint, both array<double>").select("n", F.posexplode("both").alias("at", "x")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    for r in summed.collect():
        n, both[divmod(r["at"], voters.size)] = r["n"], r["x"]
    votes, x = voters.look(evidence)
    model = LabelModel.fit(n, both.diagonal().copy(), both, float(np.clip(toxic.mean(), 1e-3, 0.5)), (votes[toxic == 0].sum(axis=0) + 0.5) / ((toxic == 0).sum() + 1), CLEAN)
    none = ~votes[:, : voters.size - CLEAN].any(axis=1)
    soft = model.posterior(votes, float(np.clip((toxic[none].sum() + 0.5) / (none.sum() + 1), 1e-4, 0.3)))
    # texts without evidence are all alike to the classifier: one row, which weighs as much as the others together
    some = np.flatnonzero(~none)
    rest = voters.look([([], [], 0, [0, 0, 0])])[1]
    weights = train_linear(np.concatenate([x[some], rest]), np.r_[soft[some], float(soft[none].mean()) if none.any() else 0.0], np.r_[np.ones(len(some)), max(1, len(some))])
    return ToxicityModel(terms, voters, weights, model), table


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch))], ["id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, training: Column | None = None) -> DataFrame:
    """(id, score) for every row: how likely the whole text is toxic, from 0 to 1. See fit_toxicity.

    Inputs of a score are the text's words alone, so equal texts score alike. Null and empty texts score like any text
    without evidence. Texts of any length are read whole, a row at a time. Repeated rows, and rows without an id, are
    scored each; extra columns of any name are left out; an empty table gives none. Where no usable label tells
    anything, the score is 0 throughout, with a warning.
    """
    model, table = fit_toxicity(docs, labels, id_col, text_col, label_col, sample, training)
    if table is None:
        warnings.warn("no label tells toxic texts from others: all score 0", stacklevel=2)
        return docs.select(docs[id_col].alias("id"), F.lit(0.0).alias("score"))
    kind = docs.schema[id_col].dataType.simpleString()
    return table.mapInArrow(_scored(model), f"id {kind}, score double")


def _kept(model: ToxicityModel, suspect: Bloom, threshold: float):
    """Of batches whose last columns are the text's hash and the text, the others of the rows that score under the threshold: a row that isn't suspect needs no look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _evidence(model.terms)
        for batch in batches:
            keep = ~suspect.test(batch.column(batch.num_columns - 2).to_numpy())
            doubtful = np.flatnonzero(~keep)
            if len(doubtful):
                texts = batch.column(batch.num_columns - 1).take(pa.array(doubtful))
                found = next(find(iter([pa.RecordBatch.from_arrays([pa.array(doubtful), texts], ["at", "text"])])))
                keep[doubtful] = model.scores(found) < threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:-2]], batch.schema.names[:-2])

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that score under the threshold. Rows need no id to be judged.

    One pass over the texts gathers all votes; the hashes of texts that score higher go to a filter of bounded size, so the
    second pass looks again at these alone, and at the few that the filter can't tell from them.
    Null and empty texts, very long ones, repeated rows and clashing column names: as in toxicity_scores.
    """
    h = F.xxhash64(docs[text_col].cast("string"))
    model, table = fit_toxicity(docs, labels, id_col, text_col, key=h)
    if table is None:
        return docs
    high = materialize(table.mapInArrow(_scored(model), "id bigint, score double").where(F.col("score") >= threshold).select("id").distinct(), "suspect")
    suspect = build(high, high.count())
    discard(table), discard(high)
    columns = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)], h.alias("_hash"), docs[text_col].cast("string").alias("_text"))
    shape = columns.select(columns.columns[:-2]).schema
    return columns.mapInArrow(_kept(model, suspect, threshold), shape).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
