"""Subject areas of documents: labels propagated over a verified graph of similar documents.

1. Texts become word hashes, sentence by sentence, once. A term is a word or two neighbouring
   ones. It is topical if documents that hold it repeat it in further sentences far more
   often than chance would have it, if several sources use it, and if readers' labels don't
   show it to go with any subject.
2. Documents are linked by MinHash: in each repetition those with the same least topical term
   form a group and each is compared with the group's representative; the link is kept if
   their term sets are similar enough, with the similarity as its weight. No pairs within a
   group are listed, no link is dropped.
3. Labels travel over the links by joins, rounds from documents to representatives and back.
   A document keeps a distribution over subjects, so several survive. Seeds that their
   neighbours bear out are trusted, and put back in every round and in the end.
4. Each subject that reached a document is checked on its sentences: the terms' weights come
   from the propagated distributions of all documents, a sentence deals with the subject for
   which its topical terms speak clearly, and the subject must hold its share of those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from ..session import BROADCAST_ROWS, checkpointed, salted_join, spread, stored
from .normal import transducer

#: Words, and where a sentence ends: a line end, or . ! ? before a blank.
_TOKENS = re.compile(r"[^\W\d_]+|[.!?](?=[ \n])|\n").findall
#: Terms that one broadcast holds (8 bytes each); a larger table of them is joined by shuffle.
TERM_ROWS = 2_000_000
#: Labels of representatives that one broadcast holds (24 bytes each).
HUB_ROWS = 1_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MOST = 2**64 - 1


def subject_form(c: Column) -> Column:
    """A subject key's compared form: lower case, blanks as underscores."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "_")


class _Words(dict):
    """Hashes of words, 0 for what ends a sentence."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) >> 1 | 1 if w[0].isalpha() else 0
        if len(self) < 1_000_000:
            self[w] = h
        return h


def _mixed(x: np.ndarray, by: np.uint64 = _B) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * by
        return x ^ (x >> np.uint64(29))


def tokens(docs: DataFrame, doc: str, text: str, source: str, lang: str | None) -> DataFrame:
    """(doc, source, lang, words): word hashes of each whole text, 0 between sentences; null texts have no row. Source and language hashed."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, hashes = transducer(), _Words()
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                words = [[hashes[w] for w in _TOKENS(form(t).lower())] for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(words, pa.list_(pa.int64()))], names=["doc", "source", "lang", "words"])

    own = docs.select(F.col(f"`{doc}`").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{source}`"), F.lit(""))).alias("source"), F.xxhash64(F.lower(F.coalesce(F.col(f"`{lang}`"), F.lit("")) if lang else F.lit(""))).alias("lang"), F.col(f"`{text}`").alias("text"))
    return spread(own.where("doc is not null and text <> ''")).mapInArrow(run, f"doc {kind}, source long, lang long, words array<long>")


def _placed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in a row with 0 between sentences, each one's document by index and sentence number)."""
    v = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.diff(words.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return v, doc, np.cumsum(v == 0) + doc


def _neighbours(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the words that another of the same sentence follows."""
    return np.flatnonzero((v[:-1] != 0) & (v[1:] != 0) & (doc[1:] == doc[:-1])) if len(v) else np.zeros(0, np.int64)


def _pairs(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(v[at] * _A + v[at + 1])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) that group equal keys."""
    order = np.argsort(keys)
    s = keys[order]
    return order, np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)


def _per_document(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's index, term, whether several sentences have it) of every word and pair of neighbours, each once a document."""
    v, doc, sent = _placed(words)
    one, two = np.flatnonzero(v), _neighbours(v, doc)
    at, term = np.concatenate([one, two]), np.concatenate([v[one], _pairs(v, two)])
    with np.errstate(over="ignore"):
        order, starts = _groups(term ^ _mixed(doc[at].astype(np.uint64) * _C))
    if not len(starts):
        return at, term, np.zeros(0, bool)
    s = sent[at[order]]
    return doc[at[order[starts]]], term[order[starts]], np.minimum.reduceat(s, starts) != np.maximum.reduceat(s, starts)


def term_counts(words: DataFrame) -> DataFrame:
    """(term, docs, again, chance, lo, hi): documents with the term, with it in several sentences, how many of these
    chance would give (as many documents hit by a Poisson process, in each language), its least and greatest source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, term, again = _per_document(b.column(2))
            lang = b.column(1).to_numpy()[doc]
            with np.errstate(over="ignore"):
                order, starts = _groups(term ^ _mixed(lang.view(np.uint64), _C))
            if len(starts):
                src = b.column(0).to_numpy()[doc[order]]
                cols = [term[order[starts]].view(np.int64), lang[order[starts]], np.diff(np.r_[starts, len(order)]), np.add.reduceat(again[order].astype(np.int64), starts), np.minimum.reduceat(src, starts), np.maximum.reduceat(src, starts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["term", "lang", "docs", "again", "lo", "hi"])

    rows = words.select("source", "lang", "words").mapInArrow(run, "term long, lang long, docs long, again long, lo long, hi long")
    own = rows.groupBy("term", "lang").agg(*[F.sum(c).alias(c) for c in ("docs", "again")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # of documents hit with rate r, 1 - exp(-r) once or more, those hit twice or more
    part = F.col("docs") / F.col("size")
    chance = F.when(part < 1, F.col("docs") * (1 + (1 - part) * F.ln(1 - part) / part)).otherwise(F.col("docs"))
    with_chance = own.join(words.groupBy("lang").agg(F.count("*").alias("size")), "lang").withColumn("chance", chance)
    return with_chance.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("docs", "again", "chance")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def seed_counts(words: DataFrame, seeds: DataFrame) -> DataFrame:
    """(term, mass, top): labelled documents with a term, and how many of them go with its most frequent subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, term, _ = _per_document(b.column(2))
            subject, share = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            with np.errstate(over="ignore"):
                order, starts = _groups(term ^ _mixed(subject.astype(np.uint64) * _C))
            if len(starts):
                yield pa.RecordBatch.from_arrays([pa.array(term[order[starts]].view(np.int64)), pa.array(subject[order[starts]], pa.int64()), pa.array(np.add.reduceat(share[order], starts))], names=["term", "subject", "mass"])

    own = words.join(F.broadcast(seeds) if seeds.count() <= BROADCAST_ROWS else seeds, "doc").select(F.col("subject").cast("long").alias("subject"), "share", "words")
    return own.mapInArrow(run, "term long, subject long, mass double").groupBy("term", "subject").agg(F.sum("mass").alias("mass")).groupBy("term").agg(F.sum("mass").alias("mass"), F.max("mass").alias("top"))


_FEATURES = "array<long>, terms array<long>, sentences array<array<long>>"


def _featured(ids: pa.Array, doc: np.ndarray, sent: np.ndarray, term: np.ndarray, repetitions: int) -> pa.RecordBatch:
    """A row for each document with a topical term: its terms, their least hash in each repetition, its sentences' terms."""
    n = len(ids)
    with np.errstate(over="ignore"):
        once = np.unique(term ^ _mixed(sent.astype(np.uint64) * _C), return_index=True)[1]
    once = once[np.lexsort((term[once], sent[once]))]
    doc, sent, term = doc[once], sent[once], term[once]
    of = doc
    starts = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]]) if len(sent) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(sent)], pa.int32()), pa.array(term.view(np.int64)))
    sentences = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[starts], np.arange(n + 1)), pa.int32()), inner)
    with np.errstate(over="ignore"):
        first = np.unique(term ^ _mixed(of.astype(np.uint64) * _C), return_index=True)[1]
    first = first[np.lexsort((term[first], of[first]))]
    of, term = of[first], term[first]
    bounds = np.searchsorted(of, np.arange(n + 1))
    full = np.flatnonzero(np.diff(bounds))
    least = np.zeros((n, repetitions), np.uint64)
    for r in range(repetitions):
        if len(full):
            least[full, r] = np.minimum.reduceat(_mixed(term + np.uint64((2 * r + 1) * int(_A) & _MOST), _B), bounds[full])
    mins = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * repetitions, pa.int32()), pa.array(least.ravel().view(np.int64)))
    terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(term.view(np.int64)))
    return pa.RecordBatch.from_arrays([ids, mins, terms, sentences], names=["doc", "mins", "terms", "sentences"]).take(pa.array(full))


def _known(top: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x.view(np.int64)
    return top[np.minimum(np.searchsorted(top, x), len(top) - 1)] == x if len(top) else np.zeros(len(x), bool)


def features(words: DataFrame, topical: DataFrame, repetitions: int) -> DataFrame:
    """(doc, mins, terms, sentences) by topical terms; by one pass with them broadcast, or beyond TERM_ROWS by a shuffle join with the same result.

    A pair of words counts where neither of them is topical by itself.
    """
    kind = words.schema["doc"].dataType.simpleString()
    if topical.count() <= TERM_ROWS:
        held = words.sparkSession.sparkContext.broadcast(np.sort(np.array([r.term for r in topical.select("term").toLocalIterator()], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = held.value
            for b in batches:
                v, doc, sent = _placed(b.column(1))
                own = _known(top, v) & (v != 0)
                two = _neighbours(v, doc)
                two = two[~own[two] & ~own[two + 1]]
                pairs = _pairs(v, two)
                kept = _known(top, pairs)
                at = np.concatenate([np.flatnonzero(own), two[kept]])
                yield _featured(b.column(0), doc[at], sent[at], np.concatenate([v[own], pairs[kept]]), repetitions)

        return words.select("doc", "words").mapInArrow(run, f"doc {kind}, mins {_FEATURES}")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, doc, sent = _placed(b.column(1))
            one, two = np.flatnonzero(v), _neighbours(v, doc)
            at, sent = np.concatenate([one, two]), sent - (sent[0] if len(sent) else 0)
            cols = [np.concatenate([v[one], _pairs(v, two)]), np.concatenate([np.zeros(len(one), np.uint64), v[two]]), np.concatenate([np.zeros(len(one), np.uint64), v[two + 1]])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[at])), pa.array(sent[at], pa.int64()), *[pa.array(c.view(np.int64)) for c in cols]], names=["doc", "sent", "term", "a", "b"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = np.diff(b.column(1).offsets.to_numpy()), b.column(1).flatten()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sent = flat.field(0).to_numpy()
            yield _featured(b.column(0), doc, doc * (int(sent.max(initial=0)) + 1) + sent, flat.field(1).to_numpy().view(np.uint64), repetitions)

    own = topical.select("term")
    rows = words.select("doc", "words").mapInArrow(out, f"doc {kind}, sent long, term long, a long, b long").join(own, "term")
    for c in ("a", "b"):
        rows = rows.join(own.withColumnRenamed("term", c), c, "left_anti")
    return rows.groupBy("doc").agg(F.collect_list(F.struct("sent", "term")).alias("x")).mapInArrow(back, f"doc {kind}, mins {_FEATURES}")


def similar(rows: DataFrame, least: float) -> DataFrame:
    """(doc, rep, weight): verified links of documents to the representatives of their groups.

    A group is a repetition's documents with one least hash. Its representative, the document
    with the least hash of its own, comes from a map-side aggregate; a group that holds a third of all
    documents joins back by broadcast or salted. Jaccard similarity of the topical terms must
    reach ``least``.
    """
    placed = rows.select("doc", "terms", F.posexplode("mins").alias("rep_no", "key"))
    groups = placed.groupBy("rep_no", "key").agg(F.min_by(F.struct("doc", "terms"), F.struct(F.xxhash64("doc", "rep_no"), "doc")).alias("r"), F.count("*").alias("n")).where("n > 1")
    reps = checkpointed(groups.select("rep_no", "key", F.col("r.doc").alias("rep"), F.col("r.terms").alias("theirs")))
    met = placed.join(F.broadcast(reps), ["rep_no", "key"]) if reps.count() <= BROADCAST_ROWS // 4 else salted_join(placed, reps, ["rep_no", "key"], "doc")
    both = F.size(F.array_intersect("terms", "theirs"))
    links = met.where("doc <> rep").select("doc", "rep", (both / (F.size("terms") + F.size("theirs") - both)).alias("weight"))
    return links.where(F.col("weight") >= least)


class Weights:
    """Terms' subjects and weights as arrays, and what sentences say by them."""

    def __init__(self, rows: list, threshold: float, margin: float = 1.5) -> None:
        self.term, self.subject, self.weight = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.argsort(self.term)
        self.term, self.subject, self.weight = self.term[order], self.subject[order], self.weight[order]
        self.threshold, self.margin = threshold, margin

    def spoken(self, sentences: pa.ListArray) -> np.ndarray:
        """The subject for which each sentence's terms speak clearly: enough, and so much more than for the next one; 0 for none."""
        flat = sentences.flatten()
        sizes = np.diff(flat.offsets.to_numpy())
        terms = flat.flatten().to_numpy()
        out = np.zeros(len(sizes), np.int64)
        if not len(self.term) or not len(terms):
            return out
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        hit = self.term[at] == terms
        sent, at = np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]
        order = np.lexsort((self.subject[at], sent))
        sent, at = sent[order], at[order]
        subject = self.subject[at]
        starts = np.flatnonzero(np.r_[True, (sent[1:] != sent[:-1]) | (subject[1:] != subject[:-1])]) if len(sent) else np.zeros(0, np.int64)
        if len(starts):
            w, sent, subject = np.round(np.add.reduceat(self.weight[at], starts), 6), sent[starts], subject[starts]
            order = np.lexsort((-subject, -w, sent))
            w, sent, subject = w[order], sent[order], subject[order]
            first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
            after = np.minimum(first + 1, len(w) - 1)
            second = np.where((after > first) & (sent[after] == sent[first]), w[after], 0.0)
            clear = first[(w[first] >= self.threshold) & (w[first] >= self.margin * second)]
            out[sent[clear]] = subject[clear]
        return out


class Subjects:
    """Fits the propagation on a corpus; ``documents()`` gives its subjects, ``makeup()`` the corpus by subject.

    Null and empty texts have no subject; a label of an unknown or null subject, and a label
    of a document that isn't there, is no seed; repeated labels are one.
    """

    def __init__(
        self, docs: DataFrame, labels: DataFrame, areas: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", lang: str | None = "lang", rounds: int = 3, repetitions: int = 8,
        similarity: float = 0.05, again: float = 2.5, threshold: float = 1.5, purity: float = 0.6, least: int = 4, smooth: float = 2.0, reach: float = 0.001,
    ) -> None:
        """``again``: by how much the odds that a topical term is repeated exceed chance. ``reach``: share of a document's propagated labels from which a subject is a candidate."""
        keys = areas.select(subject_form(F.col("subject_key")).alias("name"), "subject_key", "title", "description").where("name is not null").dropDuplicates(["name"])
        n = keys.count()
        if n > 10_000:
            raise ValueError("the subject table is broadcast; it holds at most 10,000 rows")
        # a small fixed table: one window over all of it
        self.keys = checkpointed(keys.withColumn("subject", F.row_number().over(Window.orderBy("name"))))
        self.prior = 1 / max(1, n)
        self.threshold, self.purity, self.least, self.smooth, self.reach = threshold, purity, least, smooth, reach
        words = stored(tokens(docs, doc, text, source, lang if lang in docs.columns else None))
        named = labels.select(F.col("doc_id").alias("doc"), subject_form(F.col("subject_key")).alias("name")).where("doc is not null").join(F.broadcast(self.keys.select("name", "subject")), "name").select("doc", "subject").distinct()
        seeds = checkpointed(named.join(words.select("doc"), "doc", "left_semi").withColumn("share", 1 / F.count("*").over(Window.partitionBy("doc"))))
        several = words.agg((F.min("source") != F.max("source")).alias("several")).first().several
        often = term_counts(words).where(f"again >= 2 and again * (docs - chance) >= {again} * chance * (docs - again)")
        # a term that all documents of one source share is that source's own, unless there is only one source
        often = often.where("lo <> hi") if several else often
        spoken = seed_counts(words, seeds).where(F.col("mass") >= least)
        topical = checkpointed(often.join(spoken, "term", "left").where(f"mass is null or top >= {0.4} * mass").select("term"))
        self.rows = stored(features(words, topical, repetitions))
        self.links = checkpointed(similar(self.rows.select("doc", "mins", "terms"), similarity))
        self.reps = checkpointed(self.links.select("rep").distinct())
        # a representative's labels: at most one for each subject
        self.hubs, self.each = self.reps.count(), max(1, n)
        self.seeds = checkpointed(self._trusted(seeds))
        self.labels = self._propagated(rounds)
        told = self.labels.where("share >= 0.1").groupBy("doc").agg(F.collect_list(F.struct(F.col("subject").cast("long").alias("subject"), "share")).alias("labels"))
        empty = F.array().cast("array<struct<subject:bigint,share:double>>")
        self.labelled = stored(self.rows.select("doc", "sentences").join(told, "doc", "left").select("doc", F.coalesce("labels", empty).alias("labels"), "sentences"))
        self.weights = self._taught(least, purity)

    def _with_hubs(self, links: DataFrame, hub: DataFrame) -> DataFrame:
        """Links joined with their representatives' labels: by broadcast if these are few, else salted, as a third of all documents may have one representative."""
        return links.join(F.broadcast(hub), "rep") if self.hubs * self.each <= HUB_ROWS else salted_join(links, hub, ["rep"], "doc")

    def _up(self, labels: DataFrame) -> DataFrame:
        """(rep, subject, mass) from the members' labels; added up before the shuffle."""
        return self.links.join(labels, "doc").groupBy("rep", "subject").agg(F.sum(F.col("weight") * F.col("share")).alias("mass"))

    def _trusted(self, seeds: DataFrame) -> DataFrame:
        """Seeds that the other labelled documents near them bear out; those without such neighbours are trusted."""
        up = checkpointed(self._up(seeds))
        # what a representative knows, without the document's own word; a representative's own label counts too
        near = self.links.join(seeds.select("doc").distinct(), "doc", "left_semi")
        near = self._with_hubs(near, up).join(seeds.select("doc", "subject", "share"), ["doc", "subject"], "left")
        seen = near.groupBy("doc", "subject").agg(F.sum(F.col("weight") * (F.col("mass") - F.coalesce("share", F.lit(0.0)) * F.col("weight"))).alias("mass")).where("mass > 1e-9")
        seen = seen.withColumn("part", F.col("mass") / F.sum("mass").over(Window.partitionBy("doc")))
        told = seen.groupBy("doc").agg(F.sum("mass").alias("all"))
        kept = seeds.join(told, "doc", "left").join(seen.select("doc", "subject", "part"), ["doc", "subject"], "left").where("all is null or part >= 0.1")
        return kept.select("doc", "subject").withColumn("share", 1 / F.count("*").over(Window.partitionBy("doc")))

    def _clamped(self, labels: DataFrame) -> DataFrame:
        """A seed's subjects hold half of its document's distribution, whatever came over the links; the rest stays, as a reader may have named one subject of several."""
        rest = labels.join(self.seeds.groupBy("doc").agg(F.lit(0.5).alias("kept")), "doc", "left").select("doc", "subject", (F.col("share") * F.coalesce("kept", F.lit(1.0))).alias("share"))
        own = self.seeds.select("doc", "subject", (F.col("share") / 2).alias("share"))
        return rest.unionByName(own).groupBy("doc", "subject").agg(F.sum("share").alias("share"))

    def _propagated(self, rounds: int) -> DataFrame:
        """(doc, subject, share) after ``rounds``, seeds clamped in each of them and in the end."""
        labels = self.seeds
        for _ in range(rounds):
            up = self._up(labels).unionByName(labels.join(self.reps.select(F.col("rep").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("rep"), "subject", F.col("share").alias("mass")))
            hub = up.groupBy("rep", "subject").agg(F.sum("mass").alias("mass")).withColumn("part", F.col("mass") / F.sum("mass").over(Window.partitionBy("rep")))
            hub = checkpointed(hub.where(f"part >= {2 * self.reach}").select("rep", "subject", "part"))
            down = self._with_hubs(self.links, hub).groupBy("doc", "subject").agg(F.sum(F.col("weight") * F.col("part")).alias("mass"))
            met = down.unionByName(hub.select(F.col("rep").alias("doc"), "subject", F.col("part").alias("mass"))).groupBy("doc", "subject").agg(F.sum("mass").alias("mass"))
            share = met.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy("doc"))).where(F.col("share") >= self.reach).select("doc", "subject", "share")
            labels = checkpointed(self._clamped(share))
        return labels

    def _weights(self, mass: DataFrame, least: int, purity: float) -> DataFrame:
        """(term, subject, weight) of the terms that go mostly with one subject; ``mass``: (term, subject, mass)."""
        top = mass.groupBy("term", "subject").agg(F.sum("mass").alias("mass")).groupBy("term").agg(F.sum("mass").alias("all"), F.max(F.struct("mass", "subject")).alias("t"))
        p = (F.col("t.mass") + self.smooth * self.prior) / (F.col("all") + self.smooth)
        kept = top.withColumn("p", p).where((F.col("all") >= least) & (F.col("p") >= purity))
        return checkpointed(kept.select("term", F.col("t.subject").cast("long").alias("subject"), (F.log(F.col("p") / self.prior) * F.col("p")).alias("weight")))

    def _spoken(self, weights: DataFrame | None) -> DataFrame:
        """(doc, labels, sentences, spoken): each sentence's subject by ``weights``, 0 for none; by one pass, or by shuffle joins beyond TERM_ROWS terms."""
        if weights is None:
            return self.labelled.withColumn("spoken", F.transform("sentences", lambda x: F.lit(0).cast("long")))
        if weights.count() <= TERM_ROWS:
            held = weights.sparkSession.sparkContext.broadcast(Weights([tuple(r) for r in weights.toLocalIterator()], self.threshold))
            schema = self.labelled.schema.simpleString()[7:-1] + ",spoken:array<bigint>"

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    own = b.column(2)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(own.offsets.to_numpy() - own.offsets[0].as_py(), pa.int32()), pa.array(held.value.spoken(own)))], names=["doc", "labels", "sentences", "spoken"])

            return self.labelled.mapInArrow(run, schema)
        terms = self.labelled.select("doc", F.posexplode("sentences").alias("n", "terms")).select("doc", "n", F.explode("terms").alias("term"))
        sums = terms.join(weights, "term").groupBy("doc", "n", "subject").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = sums.groupBy("doc", "n").agg(F.max(F.struct("w", "subject")).alias("b"), F.sort_array(F.collect_list("w"), asc=False).alias("ws"))
        clear = best.where((F.col("b.w") >= self.threshold) & (F.col("b.w") >= 1.5 * F.coalesce(F.get("ws", F.lit(1)), F.lit(0.0))))
        said = clear.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("n", "b.subject"))).alias("m"))
        return self.labelled.join(said, "doc", "left").select("doc", "labels", "sentences", F.transform("sentences", lambda x, i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("spoken"))

    def _mass(self, weights: DataFrame | None) -> DataFrame:
        """(term, subject, mass): a term's sentences with a subject of their own, any other by its document's labels; added up in each batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                labels, own = b.column(1), b.column(2)
                flat = own.flatten()
                per_sent, terms = np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy()
                doc = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy())), per_sent)
                spoken = np.repeat(b.column(3).flatten().to_numpy(), per_sent)
                many, first = np.diff(labels.offsets.to_numpy()), labels.offsets.to_numpy()[:-1] - labels.offsets[0].as_py()
                subject, share = labels.flatten().field(0).to_numpy(), labels.flatten().field(1).to_numpy()
                rest = np.flatnonzero(spoken == 0)
                n = many[doc[rest]]
                place = np.repeat(first[doc[rest]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                t = np.concatenate([terms[spoken > 0], np.repeat(terms[rest], n)])
                s = np.concatenate([spoken[spoken > 0], subject[place]])
                m = np.concatenate([np.ones(int((spoken > 0).sum())), share[place]])
                with np.errstate(over="ignore"):
                    order, starts = _groups(t.view(np.uint64) ^ _mixed(s.astype(np.uint64) * _C))
                if len(starts):
                    yield pa.RecordBatch.from_arrays([pa.array(t[order[starts]]), pa.array(s[order[starts]], pa.int64()), pa.array(np.add.reduceat(m[order], starts))], names=["term", "subject", "mass"])

        return self._spoken(weights).mapInArrow(run, "term long, subject long, mass double")

    def _taught(self, least: int, purity: float) -> DataFrame:
        """Term weights from all documents' propagated labels, then once more with the sentences that speak clearly."""
        return self._weights(self._mass(self._weights(self._mass(None), 2, 0.45)), least, purity)

    def documents(self, share: float = 0.25) -> DataFrame:
        """(doc, subject_key, share): subjects that reached a document and hold ``share`` of its sentences with any subject."""
        said = self._spoken(self.weights).select("doc", F.explode(F.filter("spoken", lambda x: x > 0)).alias("subject"))
        counts = said.groupBy("doc", "subject").agg(F.count("*").alias("n"))
        every = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("doc")))
        kept = every.where(F.col("share") >= share - 1e-12).join(self.labels.select("doc", "subject"), ["doc", "subject"], "left_semi")
        return kept.join(F.broadcast(self.keys.select("subject", "subject_key")), "subject").select("doc", "subject_key", "share")

    def makeup(self, share: float = 0.25) -> DataFrame:
        """(subject_key, documents, weight): how many documents deal with each subject, whole and by shares."""
        return self.documents(share).groupBy("subject_key").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 6).alias("weight"))
