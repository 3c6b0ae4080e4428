"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon comes from labelled texts: words, and stems that go on, which are far more frequent in toxic than in clean
ones, weighted by log odds. Its words stand in a trie. The product of the trie with the Levenshtein automata (one edit,
for terms of FUZZY letters or more) is determinised state by state as words ask for it, so a word is looked up in one
transition a letter, and most words die after a few. The query's automaton is ``loose``: edits reach stems and words of
four letters too, swapped letters are one edit, and digits or signs inside a word don't cut it. Each hit is scored with the words around it:
quotation, words of reporting and direct address each multiply it by a factor. The factors, and a logistic score over the
hits of the whole text, are fitted on the labelled sample.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_ids, bounded_sample, written

#: Bound of the learning sample: labelled texts of each class. It bounds the lexicon too.
SAMPLE = 6000
#: A term needs LEAST toxic texts and, at two deviations less, LIFT times its share among clean ones. Stems have STEM
#: letters at least, and one longer term may not make up ALONE of a stem's texts.
LEAST, LIFT, STEM, ALONE = 5, 8.0, 3, 0.85
#: Words from so many letters on match with one edit, at a share of the weight.
FUZZY, FUZZY_SHARE = 5, 0.6
#: Loose only: words of SHORT letters match with one edit where the first letter stays and none is lost, at a lower share.
SHORT, SHORT_SHARE = 4, 0.3
WINDOW = 4
#: What a hit inside quotation marks, near a word of reporting, near a word of address is multiplied by, before the sample
#: says otherwise; the factors it may choose; and what a factor away from the first costs, in log likelihood a squared log.
CONTEXT = (0.3, 0.6, 1.25)
FACTORS, PRIOR = (0.03, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.25, 1.6, 2.0), 1.0
QUOTED, REPORTED, ADDRESSED = 1, 2, 4
LETTERS = re.compile(r"[^\W\d_]+")
#: Words joined by digits or signs inside: one token to a loose automaton. SPLIT_WORD is the same for Spark.
JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[\d@$!*+#._'’-]{1,2}[^\W\d_]++)+")
SPLIT_WORD = r"\p{L}++(?:[\p{Nd}@$!*+#._'’-]{1,2}\p{L}++)+"
#: Quotation marks (single ones only where no apostrophe can stand), words of reporting, and words of direct address.
OPENING = re.compile(r"[\"“”„«»]|(?<!\w)['‘’](?=\w)")
CLOSING = re.compile(r"[\"“”„«»]|(?<=[\w.,!?])['‘’](?!\w)")
REPORTING = frozenset("said says called wrote word term quote quoted dit écrit mot sagte nannte wort dijo llamó palabra".split())
ADDRESS = frozenset("you your you're u tu toi vous ton votre du dich dir ihr euch tú usted vosotros eres".split())


class Automaton:
    """Words and stems with weights; lookup(word) gives (term, edits) of its best match, or None.

    A state is a set of (trie node, edits so far). A letter keeps a position by matching, or spends the edit by
    inserting, substituting or deleting. States get numbers on first sight.

    ``loose`` adds: two neighbours swapped are one edit; stems of FUZZY letters or more take the edit before their last
    letter (there it would cut the stem by one); words of SHORT letters take it where the first letter stays and the
    looked-up word isn't shorter.
    """

    def __init__(self, terms: dict[str, float], loose: bool = False):
        self.terms, self.loose = terms, loose
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.fuzzy = [False]  # nodes on the way to a term that may hold an edit
        for term in terms:
            node, is_stem = 0, term.endswith("*")
            letters = term.rstrip("*")
            may_edit = len(letters) >= FUZZY and (loose or not is_stem)
            short = loose and not is_stem and len(letters) == SHORT
            for c in letters:
                self.fuzzy[node] |= may_edit or (short and node > 0)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(False)
                node = self.children[node][c]
            self.fuzzy[node] |= may_edit or short
            (self.stem_at if is_stem else self.word_at)[node] = term
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[list[tuple[int, float, str]]] = []
        self.start = self._number({(0, 0, "", "")})

    def _number(self, positions: set) -> int:
        """Positions are (node, edits, stem matched so far, letter still due); deletions are taken along.

        ``+`` is due after a stem: any letter, since a stem alone is no match.
        """
        full = set(positions)
        for node, edits, stem, due in positions:
            if not edits and not stem and not due and self.fuzzy[node]:
                full |= {(child, 1, "", "") for child in self.children[node].values() if self.fuzzy[child]}
        key = frozenset(full)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            least = SHORT if self.loose else FUZZY
            ends = {(edits, -self.terms[t], t) for node, edits, stem, due in key if not due and (t := stem or self.word_at.get(node)) and (not edits or len(t) >= least)}
            self.ends.append(sorted(ends))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, stem, due in self.sets[state]:
            if stem:
                out.add((node, edits, stem, ""))
                continue
            if due:
                if c == due:
                    out.add((node, edits, "", ""))
                continue
            child = self.children[node].get(c)
            if child is not None and (not edits or self.fuzzy[child]):
                out.add((child, edits, "", ""))
            if child in self.stem_at and (not edits or len(self.stem_at[child]) > FUZZY):
                out.add((child, edits, self.stem_at[child], "+"))
            if not edits and self.fuzzy[node]:
                out.add((node, 1, "", ""))
                out |= {(x, 1, "", "") for x in self.children[node].values() if self.fuzzy[x]}
                if self.loose:
                    swapped = ((first, self.children[x].get(c)) for first, x in self.children[node].items() if first != c)
                    out |= {(x, 1, "", first) for first, x in swapped if x is not None and self.fuzzy[x]}
        self.moves[state][c] = to = self._number(out) if out else -1
        return to

    def lookup(self, word: str) -> tuple[str, int] | None:
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        for edits, _, term in self.ends[state]:
            if not edits or len(term) >= FUZZY or (word[0] == term[0] and len(word) >= len(term)):
                return term, edits
        return None


def factor(context: int, factors: tuple) -> float:
    """Product of the factors of what holds: QUOTED, else REPORTED, and ADDRESSED."""
    quoted, reported, addressed = factors
    return (quoted if context & QUOTED else reported if context & REPORTED else 1.0) * (addressed if context & ADDRESSED else 1.0)


def hits(text: str, automaton: Automaton, memory: dict, factors: tuple = CONTEXT) -> list[tuple[str, str, int, int, float, int]]:
    """(term, word, position of the word, edits, score, context) of each match in the whole text."""
    lowered = text.lower()
    words = LETTERS.findall(lowered)

    def match_of(w: str) -> tuple[str, int] | None:
        match = memory.get(w, 0)
        if match == 0:
            if len(memory) > 1_000_000:
                memory.clear()
            memory[w] = match = automaton.lookup(w)
        return match

    found = [(i, i, w, match) for i, w in enumerate(words) if (match := match_of(w))]
    joined = [(m.span(), match) for m in JOINED.finditer(lowered) if (match := match_of(m[0]))] if automaton.loose else []
    if not found and not joined:
        return []
    at = [m.span() for m in LETTERS.finditer(lowered)]
    if joined:  # a token counts where no part of it is an exact hit; fuzzy hits of its parts give way
        exact = {i for i, _, _, (_, edits) in found if not edits}
        starts = [x for x, _ in at]
        for (x, y), match in joined:
            i, j = bisect_left(starts, x), bisect_left(starts, y) - 1
            if not exact & set(range(i, j + 1)):
                found = [f for f in found if not i <= f[0] <= j]
                found.append((i, j, lowered[x:y], match))
        found.sort()
    out = []
    for i, j, w, (term, edits) in found:
        score = automaton.terms[term] * ((FUZZY_SHARE if len(term) >= FUZZY else SHORT_SHARE) if edits else 1.0)
        x, y = at[i][0], at[j][1]
        first, last = at[i - WINDOW][0] if i >= WINDOW else 0, at[j + WINDOW][1] if j + WINDOW < len(at) else len(lowered)
        around = set(words[max(0, i - WINDOW) : i] + words[j + 1 : j + 1 + WINDOW])
        quoted = OPENING.search(lowered, max(0, first - 1), x + 1) and CLOSING.search(lowered, y, last + 1)
        context = QUOTED * bool(quoted) + REPORTED * bool(around & REPORTING) + ADDRESSED * bool(around & ADDRESS)
        out.append((term, w, i, edits, score * factor(context, factors), context))
    return out


def summaries(row: np.ndarray, term: np.ndarray, plain: np.ndarray, times: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Features of texts from their hits (row of the text, number of the term, score without context, factor of context).

    Sum and largest of the scores, terms found, scores a word, and whether anything was found; the third and the last count a
    hit by its factor, at most once.
    """
    n, score, share = len(n_words), plain * times, np.minimum(times, 1.0)
    total = np.bincount(row, score, n)
    most, some = np.zeros(n), np.zeros(n)
    np.maximum.at(most, row, score)
    np.maximum.at(some, row, share)
    key, of = np.unique(row * (term.max(initial=0) + 1) + term, return_inverse=True)
    each = np.zeros(len(key))
    np.maximum.at(each, of, share)
    terms = np.bincount(key // (term.max(initial=0) + 1), each, n)
    return np.stack([np.log1p(total), most, np.sqrt(terms), np.log1p(100 * total / (n_words + 30)), some], axis=1)


def _arrays(found: list[list], numbers: dict[str, int], factors: tuple) -> tuple[np.ndarray, ...]:
    """(row, term, plain score, context) of the hits of many texts."""
    flat = [(r, numbers[h[0]], h[4] / factor(h[5], factors), h[5]) for r, hs in enumerate(found) for h in hs]
    row, term, plain, context = zip(*flat, strict=True) if flat else ((), (), (), ())
    return np.array(row, np.int64), np.array(term, np.int64), np.array(plain, float), np.array(context, np.int64)


def _times(context: np.ndarray, factors: tuple) -> np.ndarray:
    return np.array([factor(c, factors) for c in range(8)])[context]


@dataclass
class Model:
    terms: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    factors: tuple = CONTEXT

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_automata: dict[tuple, tuple[Automaton, dict]] = {}


def _automaton(terms: dict[str, float]) -> tuple[Automaton, dict]:
    """One per worker process and lexicon, with its memory of words."""
    key = tuple(sorted(terms.items()))
    if key not in _automata:
        _automata.clear()
        _automata[key] = (Automaton(terms, loose=True), {})
    return _automata[key]


def _shared(a: Column, b: Column) -> Column:
    """Letters that two strings begin with alike, by halving steps; 0 if one is null."""
    least = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << j) for j in range(30, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda k, s: F.when((s <= least - k) & (F.substring(a, F.lit(1), k + s) == F.substring(b, F.lit(1), k + s)), k + s).otherwise(k))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(found)


#: Beginnings up to LONG letters are grouped; those of longer words, which are rare, are found by order.
LONG = 64


def _stems(counts: DataFrame, significant: Callable[[Column, Column], Column]) -> DataFrame:
    """(term, stem) for distinct words (term, t, c) and the shorter beginnings of STEM letters or more after which two words part,
    as far as they can be significant.

    A stem has at most the toxic texts of all its words, and at least the clean ones of any. Beginnings are grouped with sums
    that combine before the shuffle, so a frequent one is no load; words part after one that has two next letters or ends.
    """
    lengths = F.explode(F.sequence(F.lit(STEM), F.least(F.length("term"), F.lit(LONG)))).alias("k")
    cut = counts.where(F.length("term") >= STEM).select("*", lengths).select("term", "t", "c", F.substring("term", F.lit(1), F.col("k")).alias("stem"), F.substring("term", F.col("k") + 1, F.lit(1)).alias("next"))
    goes_on = F.col("next") != ""
    places = cut.groupBy("stem").agg(F.min("next").alias("a"), F.max("next").alias("b"), F.sum(F.when(goes_on, F.col("t")).otherwise(0)).alias("t"), F.max(F.when(goes_on, F.col("c")).otherwise(0)).alias("c"))
    places = places.where((F.col("a") != F.col("b")) & significant(F.col("t"), F.col("c"))).select("stem")
    found = cut.where(goes_on).select("term", "stem").join(places, "stem")

    by_start = Window.partitionBy("start")
    nearby = counts.where(F.length("term") > LONG).withColumn("start", F.substring("term", 1, LONG)).withColumn("n", _shared(F.col("term"), F.lag("term").over(by_start.orderBy("term"))))
    nearby = nearby.withColumn("longest", F.greatest("n", F.lead("n", 1, 0).over(by_start.orderBy("term"))))
    shared = nearby.where(F.col("n") > LONG)
    own = nearby.join(shared.groupBy("start").agg(F.collect_set("n").alias("lengths")), "start").withColumn("k", F.explode(F.filter("lengths", lambda k: (k <= F.col("longest")) & (k < F.length("term")))))
    own = own.select("term", "t", "c", F.substring("term", F.lit(1), F.col("k")).alias("stem"))
    far = shared.select(F.substring("term", F.lit(1), F.col("n")).alias("stem")).distinct()
    far = own.groupBy("stem").agg(F.sum("t").alias("t"), F.max("c").alias("c")).where(significant(F.col("t"), F.col("c"))).join(far, "stem", "left_semi").select("stem")
    return found.select("term", "stem").union(own.select("term", "stem").join(far, "stem").select("term", "stem"))


def lexicon(texts: DataFrame) -> dict[str, float]:
    """Words, and stems marked ``*`` that longer words start with, from rows (text, label): log odds of toxic texts.

    Counts are of texts, gathered by Spark over all rows given; what is significant comes to the driver, all of it. Words
    stay beside any stem, so that they keep their own edits. A stem goes if a word makes up ALONE of its texts, if a longer
    stem has all of them, or if a shorter one of no less gain stays (words are never dropped for a stem).
    """
    n = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    if not n.get(1):
        return {}

    def significant(t: Column, c: Column) -> Column:
        return (t >= LEAST) & ((t - 2 * F.sqrt(t)) / n[1] >= LIFT * (c + 1) / (n.get(0, 0) + 1))

    def best(counts: DataFrame) -> DataFrame:
        odds = F.log(F.col("t") / n[1] / ((F.col("c") + 1) / (n.get(0, 0) + 1)))
        return counts.where(significant(F.col("t"), F.col("c"))).select("term", "t", odds.alias("weight"))

    sums = F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")
    pure, joined = (F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)) for pattern in (r"\p{L}+", SPLIT_WORD))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "label", pure.alias("ws"), joined.alias("joined"))
    counts = numbered.select("label", F.explode(F.array_distinct(F.concat("ws", "joined"))).alias("term")).groupBy("term").agg(*sums)
    counts = written(counts, "toxicity-words")
    wanted = _stems(counts.where(F.col("term").rlike(r"^\p{L}+$")), significant)
    uses = numbered.select("row", "label", F.explode(F.array_distinct("ws")).alias("term")).join(wanted, "term").select("row", "label", "stem").distinct()
    stems = uses.groupBy(F.concat("stem", F.lit("*")).alias("term")).agg(*sums)
    return _without_repeats({r.term: (r.t, float(r.weight)) for r in best(counts).union(best(stems)).collect()})


def _without_repeats(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """term -> (texts, weight) to term -> weight, without stems that add nothing."""
    stems = {t[:-1]: v for t, v in found.items() if t.endswith("*")}
    lengths = sorted({len(s) for s in stems})
    in_word, in_stem = dict.fromkeys(stems, 0), dict.fromkeys(stems, 0)
    for term, (texts, _) in found.items():
        letters, kept = term.rstrip("*"), in_stem if term.endswith("*") else in_word
        for k in lengths:
            start = letters[:k]
            if k <= len(letters) and start in stems and (kept is in_word or k < len(letters)):
                kept[start] = max(kept[start], texts)
    left = {s: t * w for s, (t, w) in stems.items() if in_word[s] < ALONE * t and in_stem[s] < t}
    covered = {s for s, gain in left.items() if any(left.get(s[:k], -1.0) >= gain for k in lengths if k < len(s))}
    return {t: w for t, (_, w) in sorted(found.items()) if not t.endswith("*") or (t[:-1] in left and t[:-1] not in covered)}


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton's method with a small ridge, all rows of one weight."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _fitted(row: np.ndarray, term: np.ndarray, plain: np.ndarray, context: np.ndarray, n_words: np.ndarray, y: np.ndarray, factors: tuple) -> tuple[float, tuple]:
    """(loss, (mean, scale, weight, bias)) of the logistic score under the factors; the loss has the factors' own cost."""
    x = summaries(row, term, plain, _times(context, factors), n_words)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weight, bias = _logistic((x - mean) / scale, y)
    z = np.clip(((x - mean) / scale) @ weight + bias, -30, 30)
    loss = float((np.logaddexp(0, z) - y * z).sum())
    return loss + PRIOR * sum(math.log(f / d) ** 2 for f, d in zip(factors, CONTEXT, strict=True)), (mean, scale, weight, bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Learn lexicon, factors of context and score from labelled rows: about ``sample`` different whole texts of each class, by
    a hash of the id, then of id and text where ids have several.

    Null labels and ids are left out; of an id labelled twice the largest label counts; equal rows are one. Other columns, whatever their names, aren't read. None without both classes. Each factor in turn takes the
    value of FACTORS that fits best; where the sample shows no such context it stays as in CONTEXT.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = bounded_ids(known, "label", "id", sample, 7).select(F.col("id").alias("labelled"), "label")
    plain_docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = plain_docs.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("label", "id", "text")
    texts = written(bounded_sample(texts, "label", sample, 71).select("label", "text"), "toxicity-sample")  # read again and again
    terms = lexicon(texts)
    numbers = {t: i for i, t in enumerate(sorted(terms))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memory = _automaton(terms)
        for batch in batches:
            found = [hits(t, automaton, memory) for t in batch.column(1).to_pylist()]
            row, term, plain, context = _arrays(found, numbers, CONTEXT)
            cuts = np.searchsorted(row, np.arange(len(found) + 1))
            lists = [[x[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (term, plain, context)]
            n = [len(t.split()) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], ["label", "n", "term", "plain", "context"])

    found = sorted(tuple(r) for r in texts.mapInArrow(run, "label int, n long, term array<long>, plain array<double>, context array<long>").collect())
    if not terms or len({r[0] for r in found}) < 2:
        return None
    y, n_words = np.array([r[0] for r in found], float), np.array([r[1] for r in found])
    row = np.repeat(np.arange(len(found)), [len(r[2]) for r in found])
    term, plain, context = (np.array([v for r in found for v in r[k]], kind) for k, kind in ((2, np.int64), (3, float), (4, np.int64)))
    factors, (loss, best) = CONTEXT, _fitted(row, term, plain, context, n_words, y, CONTEXT)
    for _ in range(2):
        for at, flag in enumerate((QUOTED, REPORTED, ADDRESSED)):
            if (context & flag).any():
                tried = [(*_fitted(row, term, plain, context, n_words, y, f), f) for f in ((*factors[:at], v, *factors[at + 1 :]) for v in FACTORS)]
                least = min(tried, key=lambda x: x[0])
                if least[0] < loss:
                    loss, best, factors = least
    return Model(terms, *best, factors)


HITS = "array<struct<term: string, word: string, position: int, edits: int, score: double, context: int>>"


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double, hits): toxicity of the whole text of each row in 0..1, and the matches behind it.

    A match has its context: QUOTED, REPORTED and ADDRESSED added up.

    Null and empty texts have no hits and the score of such texts; without a model all scores are 0. Repeated rows stay.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("position", pa.int32()), ("edits", pa.int32()), ("score", pa.float64()), ("context", pa.int32())]))
    names = ("term", "word", "position", "edits", "score", "context")
    factors = model.factors if model else CONTEXT
    numbers = {t: i for i, t in enumerate(sorted(model.terms))} if model else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memory = _automaton(model.terms if model else {})
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [hits(t, automaton, memory, factors) for t in texts]
            s = np.zeros(len(texts))
            if model:
                row, term, plain, context = _arrays(found, numbers, factors)
                n = np.array([len(t.split()) if h else 0 for h, t in zip(found, texts, strict=True)])
                s = model.score(summaries(row, term, plain, _times(context, factors), n))
            listed = pa.array([[dict(zip(names, x, strict=True)) for x in h] for h in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), listed], ["id", "score", "hits"])

    return kept.mapInArrow(run, f"id {id_type}, score double, hits {HITS}").withColumnRenamed("id", id_col)
