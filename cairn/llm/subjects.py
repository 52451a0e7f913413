"""The subject areas of documents, by class-association rules over their sentences.

Transactions are sentences, items their words, classes the subjects of documents that are known. Rules are mined by
parallel frequent-pattern growth (cairn.llm.rules); of several words, only those stay that are clearly surer than each of
their parts (redundant rules are pruned). A rule's confidence is smoothed towards the subject's share and, for one word,
capped by Bayes' bound P(subject) / P(word), taken from counts over all documents of a language, which unmasks words that
a small labelled sample shows with one subject only. Each sentence goes to the subject of its surest rule, a document has
the subjects that get enough of its sentences. As labelled documents are few, the documents told clearly by the first
rules are mined in further rounds; these, like all scores, run over the whole corpus.

Sentences are read once, into arrays; every later pass over them is one of arrays and rules that each worker has.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.digest import strip
from cairn.llm import rules as mining
from cairn.session import cut, shared_folder

#: Rules need this confidence (beyond chance), with this weight of the prior in it for each of their words.
SURE, SMOOTHING = 0.55, 0.5
#: Words must be in so many documents, and this share, of some language; patterns of several words in so many sentences.
LEAST_DOCS, LEAST_SHARE, LEAST_SENTENCES = 3, 1e-4, 3
#: A voter's clear subject has this share of its sentences, and so many sentences.
CLEAR, CLEAR_SENTENCES = 0.2, 2
#: Rules of several words must be surer than their parts by this, and have so many words at most.
GAIN, LONGEST = 0.1, 3
#: Labelled documents of one subject only from which on those of several aren't needed to learn it.
ALONE = 5
#: The bound of the labelled sample (documents, by hash), languages are thought to have so many documents at least.
MOST_LABELLED, LEAST_LANGUAGE = 20_000, 50
#: (share of sentences, number of sentences) that a subject needs; the labelled documents choose among them.
THRESHOLDS = ((0.25, 2), (0.2, 2), (0.3, 2), (0.35, 2), (0.25, 1), (0.2, 1), (0.3, 1), (0.35, 1))
ROUNDS, SHARDS, ROWS_AT_ONCE = 2, 64, 2_000
#: Words below this plain confidence for every subject aren't mined.
TELLING = 0.2

_LINKS = re.compile(r"https?://\S+|www\.\S+")
_UNSEEN = re.compile(r"[\u200b-\u200f\u00ad\u2060\ufeff]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPEAKER = re.compile(r"^\[\d\d:\d\d\]\s+[^:]*:")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
TABLE = "doc bigint, n int, sizes array<int>, items array<bigint>"


def sentence_words(text: str) -> list[list[str]]:
    """The words of each sentence (or line) of two words or more, case, links, entities and Unicode form left aside."""
    text = _UNSEEN.sub("", _LINKS.sub(" ", unicodedata.normalize("NFKC", html.unescape(text)))).casefold()
    lists = [_WORD.findall(_SPEAKER.sub("", s.strip("> \t\r"))) for s in _SENTENCE.split(text)]
    return [w for w in lists if len(w) >= 2]


def _language(column: Column) -> Column:
    code = F.substring(F.lower(strip(column)), 1, 2)
    return F.when(code.rlike("^[a-z]{2}$") & (code != "un"), code).otherwise("?")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def read_sentences(documents: DataFrame, key: str, text: str, language: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sentences and the counts of their words, in one pass over the texts.

    Sentences: (doc, n, sizes, items), one row per document with a sentence: its n sentences have so many of the items
    (hashes of words of three letters or more, each once a sentence). Counts: (item, language, docs); item 0 counts documents.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                docs, tongues, n, words, lengths = [], [], [], [], []
                for k, g, t in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    if t and (sentences := sentence_words(t)):
                        docs.append(k)
                        tongues.append(g)
                        n.append(len(sentences))
                        for s in sentences:
                            s = {w for w in s if len(w) > 2}
                            words.extend(s)
                            lengths.append(len(s))
                if not docs:
                    continue
                coded = pa.array(words, pa.string()).dictionary_encode()
                codes = coded.indices.to_numpy()
                if len(known) > 300_000:
                    known.clear()
                hashes = []
                for w in coded.dictionary.to_pylist():
                    if (h := known.get(w)) is None:
                        h = known[w] = (xxhash.xxh64_intdigest(w) >> 1) | 1
                    hashes.append(h)
                hashes = np.array(hashes, dtype=np.int64)
                n, lengths = np.array(n, dtype=np.int32), np.array(lengths, dtype=np.int32)
                per_doc = np.add.reduceat(lengths, np.cumsum(n) - n)
                empty = pa.nulls(len(docs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(n), _lists(lengths, n), _lists(hashes[codes] if len(codes) else np.zeros(0, np.int64), per_doc), empty, pa.nulls(len(docs), pa.string()), empty], names=names)
                of_doc, v = np.repeat(np.arange(len(docs)), per_doc), max(1, len(hashes))
                tongue_names = sorted(set(tongues))
                tongue = np.array([tongue_names.index(g) for g in tongues])
                pair = np.unique(of_doc * v + codes)
                found, times = np.unique(tongue[pair // v] * v + pair % v, return_counts=True)
                total = np.bincount(tongue, minlength=len(tongue_names))
                item = np.concatenate([hashes[found % v], np.zeros(len(total), np.int64)]) if len(found) else np.zeros(len(total), np.int64)
                at, times = np.concatenate([found // v, np.arange(len(total))]), np.concatenate([times, total])
                nothing = pa.nulls(len(item))
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(item), pa.int32()), nothing.cast(pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.list_(pa.int32())), nothing.cast(pa.list_(pa.int64())), pa.array(item), pa.array([tongue_names[i] for i in at]), pa.array(times, pa.int64())], names=names)

    schema = f"kind int, {TABLE}, item bigint, language string, docs bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    slim = documents.select(documents[key].cast("bigint").alias("doc"), _language(documents[language]).alias("language"), documents[text].cast("string").alias("text")).where("doc is not null")
    path = shared_folder(documents.sparkSession, "subjects")
    slim.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    read = lambda kind, of: documents.sparkSession.read.schema(f"{of}, kind int").parquet(path).where(F.col("kind") == kind).drop("kind")
    return read(0, TABLE), read(1, "item bigint, language string, docs bigint").groupBy("item", "language").agg(F.sum("docs").alias("docs"))


def labels_of(labels: DataFrame, codes: list[str]) -> dict[int, list[int]]:
    """The subjects (their numbers, none for a null subject) of at most MOST_LABELLED labelled documents."""
    subject = F.lower(strip(labels["subject"]))
    rows = labels.select(labels["doc_id"].cast("bigint").alias("doc"), F.when(subject.isin(*codes), subject).alias("subject")).where("doc is not null")
    sample = rows.groupBy("doc").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc")).limit(MOST_LABELLED)
    return {r.doc: sorted(codes.index(s) for s in r.subjects) for r in sample.collect()}


def voting(labels: dict[int, list[int]]) -> dict[int, list[int]]:
    """The labels to learn from: documents of several subjects count for those that fewer than ALONE documents have alone."""
    alone = Counter(s[0] for s in labels.values() if len(s) == 1)
    kept = {d: s if len(s) < 2 else [c for c in s if alone[c] < ALONE] for d, s in labels.items()}
    return {d: s for d, s in kept.items() if s or not labels[d]}


@dataclass
class Rules:
    """Rules as arrays, for every worker: sorted keys of one, two and three items and the packed (confidence, class) of each.

    The key of several items is made from them in ascending order; heads are the keys of the first two of three.
    """

    keys: list[np.ndarray]
    values: list[np.ndarray]
    heads: np.ndarray
    members: np.ndarray
    classes: int

    @staticmethod
    def key(*items: np.ndarray) -> np.ndarray:
        h = items[0].astype(np.uint64)
        for i in items[1:]:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return h.view(np.int64)

    @classmethod
    def of(cls, table: pa.Table, classes: int) -> Rules:
        """From (items, class, confidence)."""
        sets = [sorted(s) for s in table["items"].to_pylist()]
        packed = np.round(table["confidence"].to_numpy() * 1e9).astype(np.int64) * classes + table["class"].to_numpy()
        size = np.array([len(s) for s in sets], dtype=np.int64)
        keys, values, heads = [], [], np.zeros(0, np.int64)
        for n in range(1, LONGEST + 1):
            rows = np.array([s for s in sets if len(s) == n], dtype=np.int64).reshape(-1, n)
            key, value = cls.key(*rows.T), packed[size == n]
            order = np.argsort(key)
            keys.append(key[order])
            values.append(value[order])
            if n == 3:
                heads = np.unique(cls.key(rows[:, 0], rows[:, 1])) if len(rows) else heads
        return cls(keys, values, heads, np.unique(np.array([i for s in sets if len(s) > 1 for i in s], dtype=np.int64)), classes)

    @staticmethod
    def _found(asked: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in asked, places in keys) of the keys that are asked for."""
        if not len(keys) or not len(asked):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(keys, asked)
        at[at == len(keys)] = 0
        good = np.flatnonzero(keys[at] == asked)
        return good, at[good]

    def surest(self, items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The packed surest rule of each sentence, -1 where none holds."""
        best = np.full(len(sizes), -1, dtype=np.int64)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        good, at = self._found(items, self.keys[0])
        np.maximum.at(best, sentence[good], self.values[0][at])
        good, _ = self._found(items, self.members)
        if not len(good):
            return best
        order = np.lexsort((items[good], sentence[good]))
        item, sentence = items[good][order], sentence[good][order]
        last = np.searchsorted(sentence, sentence, "right")
        pairs = self._later(np.arange(len(item)), last)
        key = self.key(item[pairs[0]], item[pairs[1]])
        good, at = self._found(key, self.keys[1])
        np.maximum.at(best, sentence[pairs[0][good]], self.values[1][at])
        good, _ = self._found(key, self.heads)
        if len(good):
            head, second = pairs[0][good], pairs[1][good]
            of, third = self._later(second, last)
            good, at = self._found(self.key(item[head[of]], item[second[of]], item[third]), self.keys[2])
            np.maximum.at(best, sentence[third[good]], self.values[2][at])
        return best

    @staticmethod
    def _later(at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of all places after those of at, up to the end of their sentence."""
        each = last[at] - at - 1
        row = np.repeat(np.arange(len(at)), each)
        return row, at[row] + 1 + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)


class Sentences:
    """A batch of the sentences' table as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.docs, self.n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        self.sizes, self.items = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        self.doc = np.repeat(np.arange(len(self.n)), self.n)  # of each sentence

    def counts(self, rules: Rules) -> np.ndarray:
        """The number of sentences of each document for each class."""
        best = rules.surest(self.items, self.sizes)
        told = best >= 0
        cell = self.doc[told] * rules.classes + best[told] % rules.classes
        return np.bincount(cell, minlength=len(self.n) * rules.classes).reshape(-1, rules.classes)

    def votes(self, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, class, weight) of the documents with one clear class."""
        k = self.counts(rules)
        total = k.sum(axis=1)
        clear = (k >= CLEAR * self.n[:, None]) & (k >= 0.3 * total[:, None]) & (k > 0)
        good = np.flatnonzero((clear.sum(axis=1) == 1) & (total >= np.maximum(CLEAR_SENTENCES, CLEAR * self.n)))
        return good, clear[good].argmax(axis=1), np.ones(len(good))

    def labelled(self, labels: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, class, weight) of labelled documents, whose classes share their weight; class -1 for those without one."""
        pairs = [(i, c, 1 / max(1, len(labels[d]))) for i, d in enumerate(self.docs.tolist()) if d in labels for c in labels[d] or [-1]]
        return tuple(np.array([p[k] for p in pairs], dtype=t) for k, t in enumerate((np.int64, np.int64, np.float64)))


def _voting(table: DataFrame, voters, run_on, schema: str) -> DataFrame:
    """run_on(sentences, documents, classes, weights) for each batch of the table that has voters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sentences = Sentences(batch)
                docs, classes, weights = voters(sentences)
                if len(docs):
                    yield from run_on(sentences, docs, classes, weights)

    return table.mapInArrow(run, schema)


def _voters(table: DataFrame, known: dict[int, list[int]] | Rules):
    """A function from sentences to the documents that vote, their classes and weights; what it needs goes to the workers once."""
    broadcast = table.sparkSession.sparkContext.broadcast(known)
    return lambda sentences: sentences.labelled(broadcast.value) if isinstance(broadcast.value, dict) else sentences.votes(broadcast.value)


def _sentences_of(sentences: Sentences, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item's place, its sentence, its vote's place) of all items of voting documents, once for each class of a document."""
    first = np.cumsum(sentences.n) - sentences.n
    start = np.cumsum(sentences.sizes) - sentences.sizes
    n = sentences.n[docs].astype(np.int64)
    which = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    vote = np.repeat(np.arange(len(docs)), n)
    size = sentences.sizes[which].astype(np.int64)
    place = np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return place, np.repeat(np.arange(len(which)), size), np.repeat(vote, size)


def mine(table: DataFrame, known: dict[int, list[int]] | Rules, rates: DataFrame, codes: list[str], least: float) -> DataFrame:
    """Rules (items, class, confidence) of words that occur least times or more in the sentences of the documents that vote."""
    voters, classes = _voters(table, known), len(codes)

    def counting(s: Sentences, docs: np.ndarray, of: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, _, vote = _sentences_of(s, docs)
        items, code = np.unique(s.items[place], return_inverse=True)
        found, cell = np.unique(code * (classes + 1) + of[vote] + 1, return_inverse=True)
        told = np.array([0] * (classes + 1) + [-1]), np.array([*range(-1, classes), -1]), np.array([*np.bincount(of + 1, minlength=classes + 1), len(np.unique(docs))])  # item 0 counts documents by class, -1 all
        columns = [np.concatenate(c) for c in zip((items[found // (classes + 1)], found % (classes + 1) - 1, np.bincount(cell, weight[vote], len(found))), told)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64()))], names=["item", "class", "n"])

    sums = [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0.0)) for c in range(classes)]
    counts = cut(_voting(table, voters, counting, "item bigint, class int, n double").groupBy("item").agg(F.array(*sums).alias("k"), F.sum("n").alias("n")), "subjects")
    voted = {r.item: r for r in counts.where("item <= 0").collect()}
    about = [k / max(1.0, voted[-1].n) for k in voted[0].k] if voted else [0.0] * classes  # shares of documents, of which one may have several subjects
    prior = [k / max(1.0, voted[0].n) for k in voted[0].k] if voted else about
    telling = (mining.most([(F.get("k", F.lit(c)) + SMOOTHING * prior[c]) / (F.col("n") + SMOOTHING) for c in range(classes)]) >= TELLING) & (F.col("n") >= least)
    ranked = counts.where("item > 0").where(telling).join(rates, "item").select("item", "n", "rate").orderBy(F.desc("n"), "item").toArrow()  # bounded: each is in LEAST_SHARE of a language's documents
    items = ranked["item"].to_numpy()
    order = np.argsort(items)
    ranks = table.sparkSession.sparkContext.broadcast((items[order], order.astype(np.int64)))

    def transactions(s: Sentences, docs: np.ndarray, of: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, sentence, vote = _sentences_of(s, docs)
        good, at = Rules._found(s.items[place], ranks.value[0])
        rank, sentence, vote = ranks.value[1][at], sentence[good], vote[good]
        sort = np.lexsort((rank, sentence))
        rank, sentence, c, w = rank[sort].tolist(), sentence[sort], of[vote[sort]].tolist(), weight[vote[sort]].tolist()
        ends = [*(np.flatnonzero(sentence[1:] != sentence[:-1]) + 1).tolist(), len(rank)] if len(rank) else []
        sets: defaultdict[tuple[tuple[int, ...], int], float] = defaultdict(float)
        start = 0
        for end in ends:
            sets[tuple(rank[start:end]), c[start]] += w[start]
            start = end
        columns = mining.conditional(sets, SHARDS)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())], names=["shard", "items", "class", "n"])

    patterns = mining.frequent(_voting(table, voters, transactions, "shard int, items array<bigint>, class int, n double"), classes, SHARDS, least, LONGEST)
    spark = table.sparkSession
    names = spark.createDataFrame(ranked.append_column("at", pa.array(np.arange(len(items)))).to_pandas()[["at", "item", "rate"]]) if len(items) else spark.createDataFrame([], "at bigint, item bigint, rate double")
    told = patterns.where(f"size(items) = 1 or counts[{classes}] >= {LEAST_SENTENCES}")
    weight = SMOOTHING * F.size("items")
    best = F.greatest(*[F.struct(((F.get("counts", F.lit(c)) + weight * F.lit(prior[c])) / (F.get("counts", F.lit(classes)) + weight)).alias("raw"), F.lit(c).alias("class")) for c in range(classes)])
    chosen = told.select("items", best.alias("best")).select("items", "best.*")
    single = chosen.where("size(items) = 1").join(F.broadcast(names), F.get("items", F.lit(0)) == F.col("at"))
    share = F.get(F.array(*[F.lit(min(p, 0.99)) for p in prior]), F.col("class"))
    beyond = lambda raw: (raw - share) / (F.lit(1.0) - share)
    cap = F.get(F.array(*map(F.lit, about)), F.col("class")) / F.col("rate")
    capped = single.select("items", "class", beyond(F.least("raw", cap)).alias("confidence"))
    rules = cut(capped.unionByName(chosen.where("size(items) > 1").select("items", "class", beyond(F.col("raw")).alias("confidence"))), "subjects")
    kept = mining.needed(rules, GAIN).where(f"confidence >= {SURE}")
    flat = kept.select("class", "confidence", F.posexplode("items").alias("i", "at"), "items").join(F.broadcast(names.select("at", "item")), "at")
    return flat.groupBy("items", "class", "confidence").agg(F.sort_array(F.collect_list("item")).alias("named")).select(F.col("named").alias("items"), "class", "confidence")


def scores(table: DataFrame, rules: Rules) -> DataFrame:
    """(doc, n, counts) of each document with evidence: how many of its n sentences are surest of each class."""
    broadcast = table.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = Sentences(batch)
                k = s.counts(broadcast.value)
                good = np.flatnonzero(k.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(s.docs[good]), pa.array(s.n[good]), _lists(k[good].astype(np.int32).ravel(), np.full(len(good), rules.classes))], names=["doc", "n", "counts"])

    return table.mapInArrow(run, "doc bigint, n int, counts array<int>")


def _enough(threshold: tuple[float, int], codes: list[str]) -> Column:
    share, least = threshold
    return F.array_compact(F.array(*[F.when((F.get("counts", F.lit(c)) >= F.lit(share) * F.col("n")) & (F.get("counts", F.lit(c)) >= least), F.lit(code)) for c, code in enumerate(codes)]))


def agreements(scored: DataFrame, labels: dict[int, list[int]], codes: list[str]) -> list[float]:
    """How well the subjects by each of THRESHOLDS agree with the labels (F1)."""
    told = scored.sparkSession.createDataFrame([(d, [codes[c] for c in s]) for d, s in labels.items()], "doc bigint, subjects array<string>")
    labelled = F.broadcast(told).join(scored, "doc", "left") if len(labels) <= MOST_LABELLED else told.join(scored, "doc", "left")
    sums = []
    for i, t in enumerate(THRESHOLDS):
        had = F.coalesce(_enough(t, codes), F.array().cast("array<string>"))
        sums += [F.sum(F.size(F.array_intersect(had, "subjects"))).alias(f"hit_{i}"), F.sum(F.size(had) + F.size("subjects")).alias(f"all_{i}")]
    r = labelled.agg(*sums).first()
    return [2 * (r[f"hit_{i}"] or 0) / max(1, r[f"all_{i}"] or 0) for i in range(len(THRESHOLDS))]


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS, report: dict | None = None) -> DataFrame:
    """(doc_id, subject) for each subject area that a substantial part of a document is about; none for most others.

    documents has doc_id, text, lang; labels has doc_id and subject (null: no subject); areas has the codes in subject.
    Null, empty and wordless texts have no rows. Codes in other case or with blanks count as the code, unknown ones are
    ignored, repeated labels count once. A wrong or missing lang only blurs the caps. Rows that repeat a doc_id are told
    apart and have the subjects of all of them. Without labels nothing can be learned: no rows. report, if given, gets
    the agreement (F1) of each of THRESHOLDS with the labels and the rules by number of words.
    """
    spark = documents.sparkSession
    codes = sorted({r.subject for r in areas.select(F.lower(strip(areas["subject"])).alias("subject")).where("subject is not null").distinct().collect()})  # the fixed list
    nothing = spark.createDataFrame([], "doc_id bigint, subject string")
    known = labels_of(labels, codes) if codes else {}
    if not any(known.values()):
        return nothing
    shares = Counter(c for s in known.values() for c in s)
    most = max(shares.values()) / sum(max(1, len(s)) for s in known.values())
    table, counts = read_sentences(documents, "doc_id", "text", "lang")
    counts = cut(counts, "subjects")
    sizes = {r.language: r.docs for r in counts.where("item = 0").collect()}  # a row per language code
    if not sizes:
        return nothing
    of_language = lambda value: F.element_at(F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(float(value(n))))]), F.col("language"))
    rate = F.col("docs") / of_language(lambda n: max(n, LEAST_LANGUAGE))
    often = F.max(F.col("docs") >= of_language(lambda n: max(LEAST_DOCS, LEAST_SHARE * n)))
    rates = counts.where("item <> 0").groupBy("item").agg(often.alias("often"), F.coalesce(F.max(F.when(F.col("language") != "?", rate)), F.max(rate)).alias("rate"))
    rates = cut(rates.where(F.col("often") & (F.col("rate") <= F.lit(2.0 * most / SURE))).select("item", "rate"), "subjects")

    labelled = cut(table.join(F.broadcast(spark.createDataFrame([(d,) for d in known], "doc bigint")), "doc", "left_semi"), "subjects")
    rules = Rules.of(mine(labelled, voting(known), rates, codes, 0.25).toArrow(), len(codes))
    for _ in range(rounds - 1):
        rules = Rules.of(mine(table, rules, rates, codes, 2.0).toArrow(), len(codes))
    scored = cut(scores(table, rules), "subjects")
    agreement = agreements(scored, known, codes)
    if report is not None:
        report |= {"agreement": dict(zip(THRESHOLDS, agreement)), "rules": [len(k) for k in rules.keys]}
    threshold = THRESHOLDS[agreement.index(max(agreement))]
    return scored.select(F.col("doc").alias("doc_id"), F.explode(_enough(threshold, codes)).alias("subject")).distinct()
