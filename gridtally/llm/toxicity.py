"""Toxicity: a weighted finite-state grammar over clauses.

A lexicon transducer turns each word into a symbol with a weight: insult, threat, target, negation,
reported speech or other. Small transducers then read the symbols of a clause: negation weakens
what follows it closely, reported speech weakens what is quoted, a target before or after an insult
strengthens it, a threat weakens until a target before or after it is found. They are composed into one table before any text
is read, and a clause scores the weights on its path. Clauses without insult or threat score
nothing and are not run. A document's clause scores become a probability through a calibrated
logistic curve.

Insults are learned: from a bounded sample of labelled rows (`Settings.per_class` and
`Settings.sample_bytes`), words and word
beginnings are counted by class, and those that best explain toxic documents are chosen one by one,
each for documents the earlier ones leave unexplained, so that words which only come along in
copies of a toxic document are not chosen. The other word lists are fixed.

Defined results: a null or empty text has no clause and gets the probability of that; labels that
are null or whose document is missing are not used; without labels of both classes the fixed lists
and a fixed curve decide. Extra columns are ignored; rows that repeat are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import stored
from gridtally.llm.quality import distinct_sample
from gridtally.llm.textbuf import Words, buffer_of, slices

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)

# Fixed word lists, with * for word beginnings.
INSULTS = "idiot* moron* stupid* loser* scum* pathetic worthless trash disgusting clown* dumb* imbecil* dummkopf* crétin* estúpid*"
THREATS = "kill* hurt* beat destroy* shoot* stab* strangle* murder* umbringen töten schlagen tuer frapper matar golpear"
TARGETS = "you your yours he she they them him her this these that those du dich dein* ihr euch tu toi vous ton ta il elle ils tú usted ustedes él ella ellos"
NEGATIONS = "not no never none nobody neither without isn aren wasn don doesn didn won nicht kein* nie niemals ne pas jamais aucun* nunca ningún ninguna jamás"
REPORTS = "said says say wrote writes claimed claims quoted reported according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según"


@dataclass(frozen=True)
class Settings:
    """per_class: labelled rows, and texts, used of each class at most. sample_bytes: size of these texts
    of a class at most. most_stems: size of the learned lexicon.

    shortest, longest: letters of a learned word beginning. least_percent: of the toxic texts that a
    stem must explain beyond those chosen before it.
    """

    per_class: int = 2000
    sample_bytes: int = 32 << 20
    most_stems: int = 300
    shortest: int = 3
    longest: int = 8
    least_percent: int = 2
    threshold: float = 0.3


@dataclass
class Model:
    """whole, start: (symbol, weight) by word and by beginning. curve: weights of `summary`, then the constant."""

    whole: dict[str, tuple[int, float]]
    start: dict[str, tuple[int, float]]
    curve: np.ndarray = field(default_factory=lambda: np.array([2.0, 0.5, 0.0, -3.0]))


# --- transducers: state and symbol to next state and factor -------------------------------------


def negation(reach: int = 3) -> dict:
    """States count the words still in reach of a negation."""
    table = {}
    for state in range(reach + 1):
        for symbol in range(6):
            if symbol == NEGATION:
                table[state, symbol] = (reach, 1.0)
            else:
                table[state, symbol] = (max(state - 1, 0), 0.3 if state and symbol in (INSULT, THREAT, TARGET) else 1.0)
    return table


def reported() -> dict:
    """State 1 follows a verb of saying, to the end of the clause: there insults and threats are not the writer's."""
    return {(state, symbol): (int(state or symbol == REPORTED), 0.5 if state and symbol in (INSULT, THREAT, TARGET) else 1.0) for state in (0, 1) for symbol in range(6)}


def targeted() -> dict:
    """State 1 follows a target. A threat that has none weakens."""
    table = {}
    for state in (0, 1):
        for symbol in range(6):
            factor = {INSULT: (1.0, 1.4), THREAT: (0.4, 1.6)}.get(symbol, (1.0, 1.0))[state]
            table[state, symbol] = (int(state or symbol == TARGET), factor)
    return table


def closing(reach: int = 3) -> dict:
    """Weights of targets that come late. States: whether a target came before, and what is open.

    Open is "close" right after an insult or a threat that had its target: one more adds a little. Or
    it is the number of words in which a threat that had none still finds one: then the target brings
    what the threat lacked. A target weighs nothing anywhere else.
    """
    table = {}
    for seen in (False, True):
        for open_ in ("", "close", *range(1, reach + 1)):
            left = open_ if isinstance(open_, int) else 0
            for symbol in range(6):
                factor, after = 1.0, left - 1 if left > 1 else ""
                if symbol == TARGET:
                    factor, after = (1.2 if left else 0.2 if open_ == "close" else 0.0), ""
                elif symbol == INSULT or (symbol == THREAT and seen):
                    after = "close"
                elif symbol == THREAT:
                    after = reach
                table[(seen, open_), symbol] = ((seen or symbol == TARGET, after), factor)
    return table


def compose(a: dict, b: dict) -> dict:
    """Both transducers reading the same symbols: states are pairs, factors multiply."""
    return {((p, q), s): ((a[p, s][0], b[q, s][0]), a[p, s][1] * b[q, t][1]) for p, s in a for q, t in b if s == t}


def grammar() -> list[list[tuple[int, float]]]:
    """The composed table, states numbered from the start state: next state and factor by symbol."""
    table = reduce(compose, (negation(), reported(), targeted(), closing()))
    start = (((0, 0), 0), (False, ""))
    numbers, queue = {start: 0}, [start]
    rows: list[list[tuple[int, float]]] = []
    while len(rows) < len(queue):
        row = []
        for symbol in range(6):
            to, factor = table[queue[len(rows)], symbol]
            if to not in numbers:
                numbers[to] = len(queue)
                queue.append(to)
            row.append((numbers[to], factor))
        rows.append(row)
    return rows


# --- words ---------------------------------------------------------------------------------------


def bare(word: bytes) -> str:
    """The word in lower case from its first letter to where its letters end."""
    text = word.decode().lower()
    if text.isalpha():
        return text
    a = next((i for i, c in enumerate(text) if c.isalpha()), len(text))
    b = next((i for i, c in enumerate(text[a:]) if not c.isalpha()), len(text) - a)
    return text[a : a + b]


def fixed_lexicon() -> Model:
    model = Model({}, {})
    for words, symbol, weight in ((INSULTS, INSULT, 1.0), (THREATS, THREAT, 1.0), (TARGETS, TARGET, 1.0), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORTED, 0.0)):
        for w in words.split():
            (model.start if w.endswith("*") else model.whole)[w.rstrip("*")] = (symbol, weight)
    return model


def _symbol(word: str, model: Model, reach: list[int]) -> tuple[int, float]:
    if word in model.whole:
        return model.whole[word]
    for n in reach:
        if word[:n] in model.start and len(word) >= n:
            return model.start[word[:n]]
    return OTHER, 0.0


# Signs that end a clause, and those that open and close a quotation.
ENDING = (b".", b",", b";", b":", b"!", b"?")
OPENING = tuple(q.encode() for q in "\"\u201c\u201e\u00ab\u2018")
CLOSING = tuple(q.encode() for q in "\"\u201d\u00bb")


def clause_ends(words: Words, ids: np.ndarray, kinds: list[bytes], symbol: np.ndarray) -> np.ndarray:
    """Whether a clause ends with each word.

    It ends at a sign of its own, where a quotation closes, at a line feed and at the text's end. A
    comma or colon does not end it where a quotation opens, or right after a verb of saying: what was
    said belongs to the clause that reports it.
    """
    bare_ends = [w.rstrip(b"\"')]*") for w in kinds]
    signs = np.array([w[-1:] in ENDING for w in bare_ends])[ids]
    mild = np.array([w[-1:] in (b",", b":") for w in bare_ends])[ids]
    closes = np.array([len(w) > 1 and w.rstrip(b".,;:!?)]*").endswith(CLOSING) for w in kinds])[ids]
    opens = np.array([w.startswith(OPENING) for w in kinds])[ids]
    goes_on = mild & ~closes & (symbol == REPORTED)
    goes_on[:-1] |= (mild & ~closes)[:-1] & opens[1:]
    ends = (signs & ~goes_on) | closes
    feeds = np.concatenate([[0], np.cumsum(words.data == 10)])
    ends[:-1] |= (feeds[words.starts[1:]] > feeds[words.ends[:-1]]) | (words.text[1:] != words.text[:-1])
    return ends


def clause_scores(words: Words, model: Model, table: list) -> tuple[np.ndarray, np.ndarray]:
    """Text index and score of every clause that has an insult or threat."""
    ids, kinds = words.encoded()
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0)
    reach = sorted({len(s) for s in model.start}, reverse=True)
    distinct = kinds.to_pylist()
    found = [_symbol(bare(w), model, reach) for w in distinct]
    symbol = np.array([f[0] for f in found], dtype=np.int8)[ids]
    weight = np.array([f[1] for f in found])[ids]
    ends = clause_ends(words, ids, distinct, symbol)
    clause = np.concatenate([[0], np.cumsum(ends[:-1])])
    hit = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
    first, last = np.searchsorted(clause, hit), np.searchsorted(clause, hit, side="right")
    scores = np.zeros(len(hit))
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        state, total = 0, 0.0
        for s, w in zip(symbol[a:b].tolist(), weight[a:b].tolist(), strict=True):
            state, factor = table[state][s]
            total += w * factor
        scores[k] = total
    return words.text[first], scores


def summary(words: Words, text: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """(texts, 3): log of the summed clause scores, the largest clause, the sum by root of the length."""
    n = len(words.offsets) - 1
    total = np.bincount(text, weights=scores, minlength=n)
    largest = np.zeros(n)
    np.maximum.at(largest, text, scores)
    return np.stack([np.log1p(total), np.minimum(largest, 8), total / np.sqrt(words.counts + 20)], axis=1)


def probability(found: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(found @ curve[:-1] + curve[-1], -40, 40)))


def held_out() -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


# --- learning ------------------------------------------------------------------------------------


def _stems(words: Words, row: int, s: Settings) -> set[str]:
    """Words (with $) of one text, and the word beginnings that it has at least twice.

    A beginning is met by chance more easily than a word, so one occurrence says little.
    """
    a, b = words.first[row], words.first[row + 1]
    raw = words.data.tobytes()
    counts = Counter(raw[x:y] for x, y in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True))
    out, begins = set(), Counter()
    for w, n in counts.items():
        w = bare(w)
        if len(w) >= s.shortest:
            out.add(w + "$")
            for k in range(s.shortest, min(len(w) - 1, s.longest) + 1):
                begins[w[:k]] += n
    out.update(w for w, n in begins.items() if n > 1)
    return out


def _counted(s: Settings):
    """Task: (y, text) to (stem, toxic, clean) counts of the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(*buffer_of(part.column("text")))
                for i, y in enumerate(part.column("y").to_pylist()):
                    counts[y].update(_stems(words, i, s))
        stems = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([counts[1][x] for x in stems], pa.int64()), pa.array([counts[0][x] for x in stems], pa.int64())], names=["stem", "toxic", "clean"])

    return run


def _present(wanted: set[str], s: Settings):
    """Task: toxic texts to the wanted stems each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(*buffer_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([sorted(_stems(words, i, s) & wanted) for i in range(part.num_rows)], pa.list_(pa.string()))], names=["doc_id", "stems"])

    return run


def _summaries(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = grammar()
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*buffer_of(part.column("text")))
                got = summary(words, *clause_scores(words, model, table))
                yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(c) for c in got.T)], names=["y", "a", "b", "c"])

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Lexicon and curve from the labelled rows that are not held out."""
    model = fixed_lexicon()
    usable = labels.where(~held_out())
    sample = distinct_sample(docs, usable, "toxic", settings.per_class, settings.sample_bytes)
    sample = stored(sample.dropDuplicates(["text", "y"]), "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return model
    toxic, clean = sizes[1], sizes[0]
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    counted = sample.select("y", "text").mapInArrow(_counted(settings), "stem string, toxic long, clean long")
    counted = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("odds", odds)
    # Ties go by the stem, so reruns agree.
    least = max(3, toxic * settings.least_percent // 100)
    likely = counted.where((F.col("toxic") >= least) & (F.col("odds") >= 2.0)).orderBy(F.desc("toxic"), "stem").limit(20 * settings.most_stems).collect()
    stems = {r["stem"]: (r["toxic"], r["odds"]) for r in likely}
    if stems:
        shown = sample.where("y = 1").select("doc_id", "text").mapInArrow(_present(set(stems), settings), "doc_id long, stems array<string>")
        texts = [r["stems"] for r in shown.orderBy("doc_id").collect()]
        for stem in chosen(stems, texts, least, settings.most_stems):
            weight = min(stems[stem][1], 8.0) / 4
            if stem.endswith("$"):
                model.whole[stem[:-1]] = (INSULT, weight)
            else:
                model.start[stem] = (INSULT, weight)
    rows = sample.mapInArrow(_summaries(model), "y int, a double, b double, c double").toArrow().sort_by([(c, "ascending") for c in ("y", "a", "b", "c")])
    x = np.stack([rows.column(c).to_numpy() for c in ("a", "b", "c")], axis=1)
    share = usable.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    model.curve = fitted(x, rows.column("y").to_numpy(), min(max(share, 1e-3), 1 - 1e-3))
    return model


def chosen(stems: dict[str, tuple[int, float]], texts: list[list[str]], least: int, most: int, wanted: int = 3) -> list[str]:
    """Stems one by one, each the one found in most texts that still lack `wanted` chosen stems.

    Of stems that are found equally often the longer is chosen: it says the same more exactly.
    """
    where: dict[str, list[int]] = {s: [] for s in stems}
    for i, own in enumerate(texts):
        for s in own:
            where[s].append(i)
    places = {s: np.array(v, dtype=np.int64) for s, v in where.items()}
    need = np.full(len(texts), wanted)
    out: list[str] = []
    while len(out) < most and places:
        gain = {s: int((need[p] > 0).sum()) for s, p in places.items()}
        top = max(gain.values())
        if top < least:
            break
        # Within five percent of the best: the surest, then the longest.
        best = max((s for s in gain if gain[s] >= 0.95 * top), key=lambda s: (round(stems[s][1], 1), len(s), s))
        out.append(best)
        need[places.pop(best)] -= 1
        word = best.rstrip("$")
        # What begins it or is begun by it adds nothing new.
        places = {s: p for s, p in places.items() if not (s.rstrip("$").startswith(word) and not best.endswith("$")) and not (word.startswith(s) and len(np.intersect1d(p, np.array(where[best]))) >= 0.9 * len(p)) and s.rstrip("$") != word}
    return out


def fitted(x: np.ndarray, y: np.ndarray, prior: float, penalty: float = 1e-3) -> np.ndarray:
    """Logistic curve by Newton's method; the classes weigh as in the labels, not as in the sample."""
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(beta))
        step = np.linalg.solve(h, z.T @ (weight * (p - y)) + penalty * beta)
        beta = beta - np.clip(step, -2, 2)
    return beta


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_clauses long"


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The rows of SCORED, one per document; n_clauses counts the matched clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = grammar()
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*buffer_of(part.column("text")))
                text, scores = clause_scores(words, model, table)
                p = probability(summary(words, text, scores), model.curve)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= settings.threshold).astype(np.int32)), pa.array(np.bincount(text, minlength=part.num_rows))],
                    names=["doc_id", "held_out", "score", "predicted", "n_clauses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCORED)
