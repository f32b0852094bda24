"""Toxicity: noisy-channel deobfuscation, then a lexicon score of the restored text.

Tokens with leetspeak, inner separators or letter runs, and runs of single letters, become character lattices. A
Viterbi search under a character language model picks the likeliest reading. Tokens of any length are read: those with
separators also by their parts and, as overlapping lattices, as several words. The language model counts all documents,
the lexicon a bounded sample of labelled ones; all texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, rolling, word_hashes

#: Labelled documents that a model is fitted on, at most; those with the smallest hash of their id.
FIT_ROWS = 20_000
ORDER = 4
#: Fixed: what a character may stand for; an empty string means that it may be left out.
LEET = {
    "0": ("o",), "1": ("i", "l"), "2": ("z",), "3": ("e",), "4": ("a",), "5": ("s",), "6": ("g", "b"), "7": ("t",), "8": ("b",), "9": ("g",),
    "@": ("a",), "$": ("s", ""), "!": ("i", "l", ""), "|": ("i", "l", ""), "+": ("t", ""), "(": ("c", ""), "<": ("c", ""), "€": ("e",), "£": ("l",),
}
DROPPED = set(".,-_*~·'\"`^:;/\\#%&=)>?[]{}")
CHANNEL = {"same": 0.0, "leet": -0.7, "dropped": -0.7, "shortened": -0.2, "kept": -4.0, "space": -1.0}
LETTERS = re.compile(r"[^\W\d_]+")
PLAIN = re.compile(r"[.,;:!?\"'()\[\]|*#$%&<>-]*([^\W\d_]+)[.,;:!?\"'()\[\]|*#$%&<>-]*")
RUN = re.compile(r"([^\W\d_])\1\1", re.I)
LETTER = re.compile(r"[^\W\d_]")
#: What may stand between words as well as inside one, for nothing but itself.
BETWEEN = re.compile("[" + re.escape("".join(sorted(DROPPED - LEET.keys()))) + "]+")
#: Lattice positions of one piece of a token, and how many of them the next piece has in common with it.
PIECE, OVERLAP = 64, 32
#: Longer tokens and their parts are not cached.
LONGEST_CACHED = 40
MOST_CACHED = 500_000
#: Cached log probabilities of a character after a state.
MOST_KNOWN = 200_000
#: Nearly every token becomes this; one object for all, as an empty frozenset of its own takes 216 bytes.
NOTHING: frozenset[str] = frozenset()
MOST_WORDS = 200_000
SHORTEST, LONGEST = 5, 7
SPARED = 20
COUNTED = ("clean_1", "clean_2", "toxic_1", "toxic_2", "clean_words")


@dataclass
class CharModel:
    """Character n-gram counts of words between ``^`` marks, scored with back-off by additive weights."""

    counts: dict[str, int] = field(default_factory=dict)
    alphabet: int = 40

    def __post_init__(self):
        self.context = Counter()
        for gram, n in self.counts.items():
            self.context[gram[:-1]] += n
        self.known: dict[tuple[str, str], float] = {}

    def log(self, state: str, c: str) -> float:
        """Log probability of c after state; each shorter context is the prior of the next longer one."""
        key = (state, c)
        if key not in self.known:
            p = 1.0 / self.alphabet
            for n in range(ORDER):
                context = state[len(state) - n :] if n else ""
                p = (self.counts.get(context + c, 0) + 5 * p) / (self.context.get(context, 0) + 5)
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            self.known[key] = math.log(p)
        return self.known[key]


def char_grams(word: str) -> Iterator[str]:
    """All n-grams up to ORDER that end inside ``word`` or at its end mark."""
    marked = "^" * (ORDER - 1) + word + "^"
    for i in range(ORDER - 1, len(marked)):
        for n in range(ORDER):
            yield marked[i - n : i + 1]


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """Per position of ``text`` its readings with their channel log probability."""
    steps, i, low = [], 0, text.lower()
    while i < len(low):
        c, j = low[i], i + 1
        while j < len(low) and low[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            reads = [(c * run, CHANNEL["same"])] if run < 3 else []
            if run > 1:
                reads += [(c, CHANNEL["shortened"])] if run > 2 else [(c, 3 * CHANNEL["leet"])]
                reads += [(c * 2, 2 * CHANNEL["shortened"])] if run > 2 else []
            steps.append(reads)
        else:
            reads = [(x * n, CHANNEL["leet"] if x else CHANNEL["dropped"]) for x in LEET.get(c, ()) for n in ({1, min(run, 2)} if x else {1})]
            if c in DROPPED:
                reads.append(("", CHANNEL["dropped"]))
            steps.append(reads or [("", CHANNEL["kept"])])
        i = j
    return steps


def decode(text: str, model: CharModel, spaced: bool) -> list[str]:
    """The likeliest words of an obfuscated text; only with ``spaced`` may it be more than one."""
    start = "^" * (ORDER - 1)
    states: dict[str, tuple[float, tuple]] = {start: (0.0, ())}
    for reads in lattice(text):
        after: dict[str, tuple[float, tuple]] = {}
        for state, (score, path) in states.items():
            options = [(state, score, path)]
            if spaced and not state.endswith("^"):
                options.append((start, score + CHANNEL["space"] + model.log(state, "^"), (path, "^")))
            for from_state, base, from_path in options:
                for read, cost in reads:
                    now, total = from_state, base + cost
                    for c in read:
                        total += model.log(now, c)
                        now = now[1:] + c
                    if now not in after or after[now][0] < total:
                        after[now] = (total, (from_path, read) if read else from_path)
        states = after
    best = max(states.items(), key=lambda s: (s[1][0] + model.log(s[0], "^"), s[0]))[1][1]
    parts = []
    while best:
        best, read = best
        parts.append(read)
    return [w for w in "".join(reversed(parts)).split("^") if w]


def suspicious(token: str) -> bool:
    """Has letters, and digits, symbols or a long run between or beside them that plain punctuation doesn't explain."""
    if PLAIN.fullmatch(token):
        return bool(RUN.search(token)) or (not token[0].isalpha() and token[0] in LEET) or (token[-1] in "$!|+")
    return bool(LETTER.search(token))


def pieces(token: str) -> list[str]:
    """A token with separators inside as overlapping pieces of PIECE lattice positions, cut before a letter run where there is one.

    A row of separators is one position: each of them is read as nothing, whatever their number.
    """
    runs = [m[0] for m in re.finditer(r"([^\W\d_])\1*|(.)\2*", BETWEEN.sub("-", token), re.S)]
    found, at = [], 0
    while True:
        found.append("".join(runs[at : at + PIECE]))
        if at + PIECE >= len(runs):
            return found
        after = at + PIECE - OVERLAP
        at = next((i for i in range(after, at + PIECE // 4, -1) if runs[i - 1] == "-"), after)


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word, longest first: itself, and its first letters if it is long."""
    return ([word] if len(word) > LONGEST or 3 <= len(word) < SHORTEST else []) + [word[:n] for n in range(min(len(word), LONGEST), SHORTEST - 1, -1)]


class Restorer(dict):
    """token -> its words, as written and as restored, reduced by ``keep``; a bounded cache."""

    def __init__(self, model: CharModel, keep):
        super().__init__()
        self.model, self.keep = model, keep

    def __missing__(self, token: str):
        words = set(x.lower() for x in LETTERS.findall(token))
        found = NOTHING
        if suspicious(token):
            parts = [x for x in BETWEEN.split(token) if x]
            cut = pieces(token)
            if len(cut) == 1:
                words.update(decode(cut[0], self.model, spaced=False))
            if len(parts) > 1:
                found = frozenset().union(*(self[x] for x in set(parts)))
            if len(parts) > 1 or len(cut) > 1:
                for x in cut:
                    words.update(decode(x, self.model, spaced=True))
        found = (frozenset(self.keep(words)) | found) or NOTHING
        if len(token) <= LONGEST_CACHED:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[token] = found
        return found

    def read(self, text: str) -> list:
        """What ``keep`` made of each token, and of each run of single letters; without what it made empty."""
        tokens = text.split()
        found = [x for x in map(self.__getitem__, tokens) if x]
        at = [i for i, t in enumerate(tokens) if len(t) == 1]
        i = 0
        while i < len(at):
            j = i + 1
            while j < len(at) and at[j] == at[j - 1] + 1:
                j += 1
            if j - i >= 3:
                end = at[j - 1] + 1
                last = tokens[end] if end < len(tokens) and len(tokens[end]) == 2 and not tokens[end].isalpha() else ""
                letters = "".join(tokens[at[i] : end]) + last
                if len(set(letters)) > 2:
                    found += [x for w in decode(letters, self.model, spaced=True) if (x := self.keep({w}))]
            i = j
        return found


@dataclass
class ToxicityModel:
    """lexicon: unit -> (weight of one occurrence, weight of several, occurrences per word of clean texts)."""

    chars: CharModel
    lexicon: dict[str, tuple[float, float, float]]
    bias: float

    def keep(self, words: set[str]) -> frozenset[str]:
        return frozenset(u for w in words if (u := next((u for u in units(w) if u in self.lexicon), None)))

    def score(self, restorer: Restorer, text: str) -> float:
        """Several occurrences count as such if they are far more than a clean text of this length would have."""
        hits = Counter(u for x in restorer.read(text) for u in x)
        n_words = text.count(" ") + text.count("\n") + 1
        total = self.bias
        for u in sorted(hits):
            once, more, rate = self.lexicon[u]
            total += more if hits[u] >= 2 and hits[u] >= 1 + 3 * rate * n_words else once
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, total))))


def fit_characters(docs: DataFrame) -> CharModel:
    """Character n-grams of the plain words of all documents, of any letters and length, each word by its occurrences."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(tokens: Counter) -> pa.RecordBatch:
            found: Counter = Counter()
            for token, n in tokens.items():
                if m := PLAIN.fullmatch(token):
                    found[m[1].lower()] += n
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["item", "n"])

        tokens: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens.update(text.split())
                if len(tokens) > MOST_WORDS:
                    yield rows(tokens)
                    tokens = Counter()
        yield rows(tokens)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["item", "n"])
        for batch in batches:
            for word, n in zip(batch.column("item").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for g in char_grams(word):
                    found[g] += n
                if len(found) > MOST_WORDS:
                    yield rows()
                    found.clear()
        yield rows()

    counted = docs.filter(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text")).mapInArrow(words, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    table = counted.mapInArrow(grams, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(table.column("item").to_pylist(), table.column("n").to_pylist(), strict=True))
    return CharModel(counts, max(CharModel.alphabet, sum(len(g) == 1 for g in counts)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit the lexicon on at most ``fit_rows`` labelled documents outside the held-out third, the characters on all documents.

    Of documents of one label with the same smallest shingle hash (copies and near copies) one counts. A unit (a word or
    the first letters of longer ones) joins the lexicon if toxic documents hold it, once or repeatedly, far beyond
    chance; its weights are log odds. A longer word or beginning that at least SPARED clean documents hold, and toxic
    ones no more than chance, has its own weights, so that it doesn't count as the unit that it begins with. Without
    labels of both kinds the lexicon is empty.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # at most fit_rows pairs of numbers
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def keyed(batches):
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                hashes = word_hashes(text.encode().split())
                keys.append(int((rolling(hashes, 5) if len(hashes) >= 5 else hashes).min()) >> 1 if len(hashes) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("doc_id"), batch.column("text"), batch.column("toxic")], names=["key", "doc_id", "text", "toxic"])

    one = texts.mapInArrow(keyed, "key long, doc_id long, text string, toxic int").groupBy("key", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))

    def count(batches):
        words, found, docs_of = 0, {}, [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tokens = Counter(m[1].lower() for m in map(PLAIN.fullmatch, text.split()) if m)
                docs_of[toxic] += 1
                own = Counter()
                for w, n in tokens.items():
                    for u in units(w):
                        own[u] += n
                words += 0 if toxic else sum(tokens.values())
                for u, n in own.items():
                    row = found.setdefault(u, [0, 0, 0, 0, 0])
                    row[2 * toxic + (n > 1)] += 1
                    row[4] += 0 if toxic else n
        rows = [("docs", "", docs_of[0], 0, docs_of[1], 0, words)]
        rows += [("unit", u, *row) for u, row in found.items()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 50_000], strict=True)], names=["kind", "item", *COUNTED])

    counts = one.select("text", "toxic").mapInArrow(count, "kind string, item string, " + ", ".join(f"{k} long" for k in COUNTED))
    counts = materialize(counts.groupBy("kind", "item").agg(*(F.sum(k).alias(k) for k in COUNTED)))
    docs_row = counts.filter("kind = 'docs'").first()
    n0, n1 = (docs_row["clean_1"], docs_row["toxic_1"]) if docs_row else (0, 0)
    clean_words = max(1, docs_row["clean_words"] if docs_row else 1)
    lexicon: dict[str, tuple[float, float, float]] = {}
    if n1 and n0:
        share = n1 / (n0 + n1)

        def surprise(toxic, clean):
            expected = (toxic + clean) * share
            return F.when((toxic >= 4) & (toxic > expected), toxic * F.log(toxic / expected) - (toxic - expected)).otherwise(0.0)

        far = F.greatest(surprise(F.col("toxic_1") + F.col("toxic_2"), F.col("clean_1") + F.col("clean_2")), surprise(F.col("toxic_2"), F.col("clean_2")))
        def weights(r):
            once, more = (math.log((r[f"toxic_{k}"] + 0.5) / (n1 + 1)) - math.log((r[f"clean_{k}"] + 0.5) / (n0 + 1)) for k in (1, 2))
            return once, max(once, more), r["clean_words"] / clean_words

        # Of the units of at most fit_rows documents those far beyond chance, and those that begin with one of them.
        found = counts.filter("kind = 'unit'").withColumn("far", far)
        for r in sorted(found.filter(F.col("far") > 8).collect(), key=lambda r: (-r["far"], r["clean_1"] + r["clean_2"], len(r["item"]), r["item"])):
            if not any(r["item"].startswith(u) or u.startswith(r["item"]) for u in lexicon):
                lexicon[r["item"]] = weights(r)
        if lexicon:
            begins = F.col("item").rlike("^(" + "|".join(map(re.escape, sorted(lexicon))) + ").")
            for r in found.filter(begins & (F.col("far") == 0) & (F.col("clean_1") + F.col("clean_2") >= SPARED)).collect():
                once = min(0.0, weights(r)[0])
                lexicon[r["item"]] = once, once, 0.0
    return ToxicityModel(fit_characters(docs), lexicon, math.log((n1 + 1) / (n0 + 1)) if n1 and n0 else -3.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Every row's ``doc_id, held_out, score, predicted``; a null text counts as empty and gets the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value.chars, shared.value.keep)
        for batch in batches:
            scores = [shared.value.score(restorer, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value.chars, shared.value.keep)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([shared.value.score(restorer, t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
