"""Toxicity by weak supervision.

Voters are word lists (one per kind of insult and language), patterns (insults close together, aimed at the
reader, spelt with digits, and so on) and word beginnings that labelled toxic texts repeat and others do not, for
insults of languages that no list covers; the beginnings are found on a bounded sample of labelled rows. A text's votes are the bits of one number; the corpus is counted by that
number, at most 2^voters rows, and everything the label model needs is in these counts. The model is a latent
class with a tree of dependencies: each voter's vote depends on the hidden label and on one other voter, the tree
being the one that explains most of the voters' conditional mutual information (Chow and Liu). Expectation-maximisation
gives the accuracies, the correlations and the label's probability for every combination of votes; rows whose label
may be learned enter with it. A logistic regression over single listed words, patterns and the density of hits is then
trained on these probabilities and scores all texts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table

#: The word lists, lower-case, by kind of insult and by language.
LEXICON = {
    "wits": """idiot idiots moron morons stupid dumb dumbass imbecile halfwit dimwit dunce fool fools foolish brainless
        cretin airhead dope blockhead numbskull simpleton nitwit retard retarded""",
    "worth": """worthless pathetic loser losers useless failure nobody hopeless pitiful inferior incompetent lowlife
        deadbeat wretch coward cowards spineless""",
    "disgust": """disgusting scum trash garbage filth filthy vermin parasite parasites pig pigs rat rats cockroach
        maggot slime vile repulsive revolting gross sickening""",
    "mockery": """clown clowns buffoon joker jackass crybaby wimp laughable ridiculous freak freaks weirdo creep creeps
        lunatic psycho""",
    "profanity": """fuck fucking fucker shit shitty bullshit bitch bitches bastard bastards asshole arse ass damn crap
        dick prick slut whore cunt piss douchebag""",
    "german": """idiot trottel dummkopf blödmann arschloch scheiße scheisse scheiß depp vollidiot abschaum versager
        drecksack mistkerl schwachkopf hurensohn wichser schlampe schwein erbärmlich wertlos widerlich""",
    "french": """imbécile crétin abruti débile connard connasse salaud salope merde ordure raclure minable nul
        dégueulasse pathétique bouffon putain enculé conne lâche""",
    "spanish": """idiota imbécil estúpido estúpida tonto tonta basura escoria patético patética inútil payaso payasa
        cabrón mierda puta puto pendejo gilipollas asqueroso asquerosa perdedor""",
}
#: Phrases aimed at the reader.
ATTACK = re.compile(r"\b(?:shut up|get lost|go away|drop dead|hate you|kill yourself|you make me sick|go to hell|nobody likes you"
                    r"|halt die klappe|fick dich|verpiss dich|ta gueule|ferme la|va te faire|cállate|vete a la)\b")
SECOND = frozenset("you your youre ur du dich dein ihr tu toi ton vous tú te eres usted".split())
#: Signs that stand for letters inside a word.
SIGNS = str.maketrans("013457@$", "oieastas")
TOKEN = re.compile(r"[^\W\d_]+")
SIGNED = re.compile(r"(?<!\w)\w*(?:[^\W\d_][013457@$]|[013457@$][^\W\d_])[\w@$]*")
NEAR = 12   # tokens between insults that stand close together
AIMED = 4   # tokens between an insult and a word for the reader
LISTS = {k: frozenset(v.split()) for k, v in LEXICON.items()}
KIND = {w: [k for k, v in LISTS.items() if w in v] for v in LISTS.values() for w in v}
TERMS = {w: i for i, w in enumerate(sorted(KIND))}
VOTERS = (*LISTS, "two_terms", "dense", "near", "aimed", "attack", "signs", "stem_twice", "stem_often", "stem_dense")
BIT = {v: 1 << i for i, v in enumerate(VOTERS)}
#: Steps of the number of hits per 1,000 tokens.
DENSITY = (1, 2, 5, 10, 20, 50)
STEM = range(4, 9)   # letters of a word's beginning
STEMS = 256          # that are used, at most


@dataclass(frozen=True)
class Reader:
    """Reads texts; ``stems`` are the word beginnings that count as hits besides the lists."""

    stems: tuple[str, ...] = ()

    @cached_property
    def number(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.stems)}

    @property
    def n_features(self) -> int:
        """Listed words, stems that come twice, voters, steps of density of listed words and of stems."""
        return len(TERMS) + len(self.stems) + len(VOTERS) + 2 * len(DENSITY)

    def read(self, text: str | None) -> tuple[int, list[int]]:
        """(votes as bits, sorted feature numbers) of a text; null counts as empty."""
        low = (text or "").lower()
        tokens = TOKEN.findall(low)
        hits = [(i, w) for i, w in enumerate(tokens) if w in TERMS]
        per_mille = 1000 / max(len(tokens), 1)
        found = {TERMS[w] for _, w in hits}
        votes = 0
        for _, w in hits:
            for k in KIND[w]:
                votes |= BIT[k]
        if len(found) > 1:
            votes |= BIT["two_terms"]
        if len(hits) > 1 and per_mille * len(hits) >= 10:
            votes |= BIT["dense"]
        if any(j - i <= NEAR for (i, _), (j, _) in zip(hits, hits[1:])):
            votes |= BIT["near"]
        if any(t in SECOND for i, _ in hits for t in tokens[max(0, i - AIMED):i + AIMED + 1]):
            votes |= BIT["aimed"]
        if ATTACK.search(low):
            votes |= BIT["attack"]
        if any(w.translate(SIGNS) in TERMS for w in SIGNED.findall(low)):
            votes |= BIT["signs"]
        number, seen, stemmed = self.number, Counter(), 0
        if number:
            for w, n in Counter(tokens).items():
                own = [w[:k] for k in STEM if w[:k] in number and len(w) >= k]
                stemmed += n * bool(own)
                seen.update({x: n for x in own})
        twice = {number[x] for x, n in seen.items() if n > 1}
        if twice:
            votes |= BIT["stem_twice"]
            if max(seen.values()) > 2:
                votes |= BIT["stem_often"]
            if per_mille * stemmed >= 5:
                votes |= BIT["stem_dense"]
        at = len(TERMS)
        found |= {at + i for i in twice}
        at += len(self.stems)
        found |= {at + i for i, v in enumerate(VOTERS) if votes & BIT[v]}
        at += len(VOTERS)
        for n in (len(hits), stemmed):
            found |= {at + i for i, d in enumerate(DENSITY) if n and per_mille * n >= d}
            at += len(DENSITY)
        return votes, sorted(found)


def repeated_stems(text: str | None) -> list[str]:
    """The word beginnings that come twice or more in a text, listed words aside."""
    words = Counter(w for w in TOKEN.findall((text or "").lower()) if w not in TERMS)
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEM:
            if len(w) >= k:
                stems[w[:k]] += n
    return [x for x, n in stems.items() if n > 1]


def telling_stems(labelled: DataFrame, sample: int = 20_000, least: float = 0.6) -> tuple[str, ...]:
    """Word beginnings that come twice in a text mostly (``least`` of the texts, smoothed) if it is toxic, the ``STEMS`` that
    tell most. ``labelled`` (text, label) is read up to about ``sample`` rows, chosen by a hash of the text."""
    n = labelled.count()
    some = labelled if n <= sample else labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def run(batches):
        for b in batches:
            tox, all_ = Counter(), Counter()
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                own = repeated_stems(t.as_py())
                all_.update(own)
                if y:
                    tox.update(own)
            yield pa.RecordBatch.from_pydict({"stem": pa.array(list(all_), pa.string()), "n": pa.array(list(all_.values()), pa.int64()),
                                              "y": pa.array([tox[x] for x in all_], pa.int64())})
    rate = some.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < rate < 1:
        return ()
    seen = some.select("text", "label").mapInArrow(run, "stem string, n long, y long").groupBy("stem").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y")).filter((F.col("y") >= 4) & ((F.col("y") + 0.5) / (F.col("n") + 1) >= least))
    weight = F.col("y") * F.log((F.col("y") + 0.5) / (F.col("n") + 1) / rate)
    return tuple(sorted(r["stem"] for r in seen.orderBy(weight.desc(), "stem").limit(STEMS).collect()))


@dataclass(frozen=True)
class LabelModel:
    prior: float                    # P(toxic)
    parent: tuple[int, ...]         # each voter's other voter, -1 for none
    table: np.ndarray               # [label, voter, vote of the other]: P(vote | label, other's vote)
    accuracy: np.ndarray            # [label, voter]: P(vote | label)
    correlation: np.ndarray         # [label, voter, voter]: correlation of two votes given the label

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row of a 0/1 matrix."""
        log = [np.log(p) + self._log(votes, y) for y, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def _log(self, votes: np.ndarray, y: int) -> np.ndarray:
        out = np.zeros(len(votes))
        for j, p in enumerate(self.parent):
            q = self.table[y, j][votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)]
            out += np.log(np.where(votes[:, j] == 1, q, 1 - q))
        return out


def _correlations(votes: np.ndarray, w: np.ndarray) -> np.ndarray:
    mean = w @ votes / w.sum()
    dev = votes - mean
    cov = (dev * w[:, None]).T @ dev / w.sum()
    sd = np.sqrt(np.diag(cov))
    return np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 0)


def _tree(votes: np.ndarray, weights: list[np.ndarray]) -> tuple[int, ...]:
    """Chow and Liu's tree over voters: the spanning tree of most mutual information given the label."""
    m = votes.shape[1]
    info, total = np.zeros((m, m)), max(sum(w.sum() for w in weights), 1.0)
    for w in weights:
        one = w @ votes
        both = (votes * w[:, None]).T @ votes
        n = w.sum()
        for a, b, joint in ((one[:, None], one, both), (one[:, None], n - one, one[:, None] - both), (n - one[:, None], one, one - both),
                            (n - one[:, None], n - one, n - one[:, None] - one + both)):
            p = np.maximum(joint, 0)
            info += np.where(p > 1e-9, p * np.log(np.maximum(p * n, 1e-300) / np.maximum(a * b, 1e-300)), 0) / total
    parent, reached, best, by = [-1] * m, {0}, info[0].copy(), np.zeros(m, int)
    while len(reached) < m:
        j = max((j for j in range(m) if j not in reached), key=lambda j: best[j])
        reached.add(j)
        parent[j] = int(by[j])
        closer = info[j] > best
        best, by = np.where(closer, info[j], best), np.where(closer, j, by)
    return tuple(parent)


def fit_labels(votes: np.ndarray, n: np.ndarray, known: np.ndarray, rounds: int = 1000, smooth: float = 1.0) -> LabelModel:
    """The label model of ``votes`` (distinct rows of 0/1), each seen ``n`` times without a label and known[:, y]
    times with label y. Starts from "more votes, likelier toxic", which fixes what the hidden label means."""
    hits = votes.sum(1)
    post = 1 - 0.4 ** hits * 0.98
    m, parent = votes.shape[1], (-1,) * votes.shape[1]
    for r in range(rounds):
        w = [known[:, 0] + n * (1 - post), known[:, 1] + n * post]
        if r in (0, 20, 50, 100):  # the tree comes first, or two voters that copy each other would pass for the label
            parent = _tree(votes, w)
        prior = (w[1].sum() + smooth) / (w[0].sum() + w[1].sum() + 2 * smooth)
        table = np.empty((2, m, 2))
        for y in (0, 1):
            base = (w[y] @ votes + smooth * 0.1) / (w[y].sum() + smooth)
            for j, p in enumerate(parent):
                for v in (0, 1):
                    own = w[y] * (votes[:, p] == v) if p >= 0 else w[y]
                    # few rows under the other's vote: towards the voter's own rate
                    table[y, j, v] = np.clip((own @ votes[:, j] + smooth * base[j]) / (own.sum() + smooth), 1e-6, 1 - 1e-6)
        accuracy = np.array([(x @ votes + smooth * 0.1) / (x.sum() + smooth) for x in w])
        model = LabelModel(float(prior), parent, table, accuracy, np.stack([_correlations(votes, x) if x.sum() > 0 else np.zeros((m, m)) for x in w]))
        before, post = post, model.posterior(votes)
        if r > 100 and np.abs(post - before).max(initial=0) < 1e-7:
            break
    return model


@dataclass(frozen=True)
class Scorer:
    reader: Reader
    labels: LabelModel
    weights: tuple[float, ...]
    intercept: float


def read_texts(docs: DataFrame, text_col: str, reader: Reader, keep: dict | None = None) -> DataFrame:
    """<keep>, votes, features of each row."""
    rows = docs.select(*[c.alias(k) for k, c in (keep or {}).items()], F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["votes int", "features array<int>"])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                votes, features = zip(*(reader.read(t.as_py()) for t in part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(votes, pa.int32()), pa.array(features, pa.list_(pa.int32()))],
                                                 names=[*part.schema.names[:-1], "votes", "features"])
    return rows.mapInArrow(run, schema)


def train(read: DataFrame, reader: Reader, penalty: float = 1e-4) -> Scorer:
    """The scorer of rows (votes, features, label or null). All rows count, summed by their votes and by their features."""
    counted = read.groupBy("votes").agg(F.count(F.when(F.col("label").isNull(), 1)).alias("n"),
                                        F.count(F.when(F.col("label") == 0, 1)).alias("n0"), F.count(F.when(F.col("label") == 1, 1)).alias("n1"))
    seen = sorted(counted.collect())  # 2 ** len(VOTERS) rows at most
    bits = np.array([[r["votes"] >> j & 1 for j in range(len(VOTERS))] for r in seen], np.int64).reshape(-1, len(VOTERS))
    n = np.array([r["n"] for r in seen], float)
    known = np.array([[r["n0"], r["n1"]] for r in seen], float).reshape(-1, 2)
    model = fit_labels(bits, n, known)
    if not len(seen):
        return Scorer(reader, model, (0.0,) * reader.n_features, float(np.log(model.prior / (1 - model.prior))))
    prob = read.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(seen, model.posterior(bits))], "votes int, p double")
    cases = scratch_table(read.groupBy("votes", "features").agg(F.count("*").alias("n")), "toxicity_cases")
    dense = F.transform(F.sequence(F.lit(0), F.lit(reader.n_features - 1)), lambda i: F.array_contains("features", i).cast("double"))
    cases = cases.join(F.broadcast(prob), "votes").select(array_to_vector(dense).alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("c")).select("features", "c.*")
    fitted = LogisticRegression(weightCol="weight", regParam=penalty, standardization=False, maxIter=100).fit(cases.filter("weight > 0"))
    return Scorer(reader, model, tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def score_column(scorer: Scorer, features="features"):
    """The classifier's probability, from the features of a text."""
    weights = F.array(*[F.lit(w) for w in scorer.weights])
    margin = F.aggregate(features, F.lit(scorer.intercept), lambda s, i: s + F.element_at(weights, i + 1))
    return 1 / (1 + F.exp(-margin))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """<id_col>, <keep>, score (0 to 1) and predicted (1 from 0.5 on) for every row of ``docs``.

    Only rows where ``learn`` holds train the model, with the 0 or 1 that ``labels`` (<id_col>, toxic) gives them, or
    without a label (of labels that repeat an id a 1 counts). Null and empty texts are scored like any text without a
    hit. Equal texts have equal scores; repeated rows and rows without an id come once each, the latter without a label.
    With no rows to learn from, all scores are those of the start values; no rows give no rows. Other columns are not read."""
    extra = keep or {}
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("__of")).agg(
        F.max("toxic").cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(learn, F.lit(False)).alias("__learn"), F.col(text_col).alias("text"),
                       *[c.alias(f"__k{i}") for i, c in enumerate(extra.values())])
    labelled = rows.filter("__learn").join(marks, F.col("__id") == F.col("__of")).select("text", "label")
    reader = Reader(telling_stems(labelled))
    read = scratch_table(read_texts(rows, "text", reader, {c: F.col(c) for c in rows.columns if c != "text"}), "toxicity_votes")
    own = read.filter("__learn").select("__id", "votes", "features")
    known = own.filter("__id is not null").join(marks, F.col("__id") == F.col("__of"), "left").select("votes", "features", "label")
    learned = known.unionByName(own.filter("__id is null").select("votes", "features", F.lit(None).cast("int").alias("label")))
    score = score_column(train(learned, reader))
    return read.select(F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(k) for i, k in enumerate(extra)], score.alias("score"),
                       (score >= 0.5).cast("int").alias("predicted"))
