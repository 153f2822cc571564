"""A library of documents on disk: ingest, search, answers, recognition, feedback and consolidation over stored tables.

A thin object: it holds paths and settings, and every method is a few DataFrame steps over the store. New documents are
a segment of their own, which alone is indexed and embedded. What has been learned is a table of events; the associative
trace, the sums of feedback, corrections and activity derive from it and from the journal.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import text as T
from siftwood.operators import answers, dense, feedback, ingest, lexical
from siftwood.operators.index import Index
from siftwood.plans import search as plans
from siftwood.scratch import materialise
from siftwood.sources import files
from siftwood.sources.store import Store, health, live, source_counts

COLUMNS = {"text": "string", "source": "string", "ext": "string", "row": "int", "line": "int", "page": "int", "section": "int", "heading": "string", "chunk": "int", "simhash": "long", "species": "string", "kind": "string", "digest": "string"}


@dataclass(frozen=True)
class Settings:
    """ivf_from: documents from which queries look in the nearest lists only. online: the ranker learns from each feedback."""

    size: int = 2
    overlap: int = 1
    refit_growth: float = 1.2
    session: int = 8
    ivf_from: int = 20_000
    online: bool = True
    decay: float = 0.0005
    reembed: float = 0.5
    relearn: float = 0.3
    photos: int = 60
    threshold: float = 0.75
    margin: float = 0.01
    search: plans.Config = plans.Config()


class Library:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.store = Store(spark, self.root)
        self.session: list[str] = []

    # --- ingest
    def index_path(self, folder: str) -> dict[str, int]:
        """Chunks all files below folder that are not stored yet; returns files, added, dups."""
        raw = files.load(self.spark, folder)
        cut = materialise(ingest.unseen(ingest.chunks(raw, self.settings.size, self.settings.overlap).where("text <> ''")), "chunks")
        known = self.store.documents()
        new = cut if known is None else cut.join(known.select("simhash").distinct(), "simhash", "left_anti")
        n = self._add(new)
        return {"files": cut.select("source").distinct().count(), "added": n, "dups": cut.count() - n}

    def index_species(self, folder: str, photo_vectors: DataFrame) -> dict[str, int]:
        """Cards and photos of ``folder/<species>/``; photo_vectors: (digest, vec) of the photos' bytes, from whatever sees them.

        Cards are cut like other texts; a photo without a vector is left out, as is one whose bytes are stored already.
        """
        cards, photos = files.species_folders(self.spark, folder)
        cut = ingest.chunks(cards.select("species", F.concat(F.lit(f"{folder}/"), "species", F.lit("/card.md")).alias("source"), "text"), self.settings.size, self.settings.overlap).where("text <> ''")
        known = self.store.documents()
        new = ingest.unseen(cut, known, within=True).withColumn("kind", F.lit("card"))
        seen = files.new_images(photos.drop("content"), known.where("digest is not null").select("digest") if known is not None else None)
        name = F.element_at(F.split("path", "/"), -1)
        pictured = seen.join(photo_vectors.select("digest").distinct(), "digest").select("species", F.col("path").alias("source"), F.concat(F.lit("[photo] "), "species", F.lit(" ("), name, F.lit(")")).alias("text"), F.lit("image").alias("kind"), "digest")
        cards.select("species", "toxic").dropDuplicates(["species"]).write.mode("append").parquet(f"{self.root}/species")
        both = materialise(new.select("species", "source", "text", "heading", "section", "chunk", "simhash", "kind").unionByName(pictured, allowMissingColumns=True), "species")
        self._add(both, photo_vectors)
        kinds = {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()}
        return {"cards": kinds.get("card", 0), "images": kinds.get("image", 0), "species": cards.select("species").distinct().count()}

    def memorize(self, text: str) -> int:
        """Stores one text as it is, known or not."""
        row = self.spark.createDataFrame([(text, None, None)], "text string, source string, heading string")
        return self._add(ingest.unseen(row))

    def _add(self, rows: DataFrame, photo_vectors: DataFrame | None = None) -> int:
        full = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))
        first, n = self.store.size(), self.store.append(full)
        if n:
            name = self.store.manifest()["segments"][-1]["name"]
            docs = self.store.documents(name)
            Index.build(docs).save(f"{self.root}/index/{name}")
            model = self.embedder()
            refit = model is None or first + n > self.settings.refit_growth * max(1, model.n_fit)
            if refit:
                self._refit(photo_vectors)
            else:
                self._write_vectors(docs, name, model, photo_vectors)
            self._event(docs.select("docid", (F.col("docid") - first + 1).alias("nth")), 1.0)
            self._list_up("all" if refit else name)
        return n

    def _write_vectors(self, docs: DataFrame, part: str, model: dense.Embedder, photo_vectors: DataFrame | None) -> None:
        """Texts by the embedder, photos by the given vectors (digest, vec)."""
        rows = model.embed(docs.where("digest is null").select("docid", "text")).select("docid", "vec")
        if photo_vectors is not None:
            seen = docs.where("digest is not null").select("docid", "digest").join(photo_vectors.dropDuplicates(["digest"]), "digest")
            rows = rows.unionByName(seen.select("docid", F.col("vec").cast("array<float>").alias("vec")))
        rows.write.mode("overwrite").parquet(f"{self.root}/vectors/fit={self.store.read_note('EMBEDDER')['fit']}/{part}")

    def _refit(self, photo_vectors: DataFrame | None = None) -> None:
        """Fits the embedder to all documents, embeds them anew and lets the trace learn them again, lightly. Old vectors stay for old events."""
        docs, before = self.store.documents(), self.store.read_note("EMBEDDER")
        model = dense.fit_embedder(docs.where("digest is null").select("docid", "text"))
        seen = photo_vectors and photo_vectors.select("digest", F.col("vec").cast("array<float>").alias("vec"))
        if before is not None:
            old = materialise(self.vectors().join(docs.where("digest is not null").select("docid", "digest"), "docid").select("digest", "vec"), "photos")
            seen = old if seen is None else old.unionByName(seen)
        fit = 0 if before is None else before["fit"] + 1
        self.store.write_note("EMBEDDER", {"fit": fit, "weights": model.weights, "direction": None if model.direction is None else model.direction.tolist(), "removed": model.removed, "n_fit": self.store.size()})
        self._write_vectors(docs, "all", model, seen)
        learned = self.store.read_note("EVENTS", {"docs": 0})["docs"]
        if learned:
            self._event(docs.where(F.col("docid") < learned).select("docid", (F.col("docid") + 1).alias("nth")), self.settings.reembed)

    def _list_up(self, part: str) -> None:
        """Assigns the lists of the inverted file to a part of the vectors; it is fitted anew after a refit and when the documents have doubled."""
        note, n = self.store.read_note("LISTS", {"n": 0}), self.store.size()
        if n < self.settings.ivf_from:
            return
        if part == "all" or n >= 2 * note["n"]:
            part, note = "all", {"n": n, "path": f"lists/n={n}"}
            fitted = dense.InvertedFile.fit(self.vectors())
            rows = [(i, v.tolist()) for i, v in enumerate(fitted.centroids)]
            self.spark.createDataFrame(rows, "list_id int, vec array<float>").write.mode("overwrite").parquet(f"{self.root}/{note['path']}/centroids")
        else:
            fitted = self.lists()
        vectors = self.vectors() if part == "all" else self.spark.read.parquet(f"{self.root}/vectors/fit={self.store.read_note('EMBEDDER')['fit']}/{part}")
        fitted.assign(vectors).sortWithinPartitions("list_id").write.mode("overwrite").parquet(f"{self.root}/{note['path']}/assigned/{part}")
        self.store.write_note("LISTS", note)

    def lists(self) -> dense.InvertedFile | None:
        note = self.store.read_note("LISTS")
        if not note:
            return None
        rows = self.spark.read.parquet(f"{self.root}/{note['path']}/centroids").orderBy("list_id").toPandas()  # 256 at most
        return dense.InvertedFile(np.stack(rows["vec"].to_numpy()).astype(np.float32))

    def embedder(self) -> dense.Embedder | None:
        note = self.store.read_note("EMBEDDER")
        return note and dense.Embedder(note["weights"], None if note["direction"] is None else np.array(note["direction"]), note["removed"], n_fit=note["n_fit"])

    def index(self) -> Index:
        return Index.load(self.store.documents(), [f"{self.root}/index/{s['name']}" for s in self.store.manifest()["segments"]])

    def vectors(self, fit: int | None = None) -> DataFrame:
        """docid, vec of the last fit, or of an earlier one."""
        fit = self.store.read_note("EMBEDDER")["fit"] if fit is None else fit
        return self.spark.read.schema("docid long, vec array<float>").option("recursiveFileLookup", "true").parquet(f"{self.root}/vectors/fit={fit}")

    def listed(self) -> DataFrame:
        """The vectors with their lists."""
        path = f"{self.root}/{self.store.read_note('LISTS')['path']}"
        return self.spark.read.schema("docid long, vec array<float>, list_id int").option("recursiveFileLookup", "true").parquet(f"{path}/assigned")

    def remove_source(self, part: str) -> int:
        return self.store.remove_source(part)

    # --- the associative trace
    def _event(self, rows: DataFrame, amount: float) -> None:
        """Appends updates of the trace: rows (docid, nth from 1), in this order."""
        note = self.store.read_note("EVENTS", {"n": 0, "docs": 0})
        made = materialise(rows.select((F.col("nth") + note["n"]).cast("long").alias("ordinal"), "docid", F.lit(float(amount)).alias("amount"), F.lit(self.store.read_note("EMBEDDER")["fit"]).alias("fit")), "events")
        made.write.mode("append").parquet(f"{self.root}/events")
        self.store.write_note("EVENTS", {"n": note["n"] + made.count(), "docs": self.store.size()})

    def events(self) -> DataFrame:
        """ordinal, docid, amount, fit: everything the trace has learned or unlearned."""
        return self.spark.read.parquet(f"{self.root}/events")

    def trace(self) -> DataFrame:
        """cell, w. An event is coded by the vector its document had when it was learned."""
        rows = None
        for fit in range(self.store.read_note("EMBEDDER")["fit"] + 1):  # one per refit
            part = self.events().where(F.col("fit") == fit).join(feedback.codes(self.vectors(fit)), "docid")
            rows = part if rows is None else rows.unionByName(part)
        return feedback.trace(rows.select("ordinal", "vec", "cells", "amount"), self.settings.decay)

    def familiarity(self, rows: DataFrame) -> DataFrame:
        """query_id, familiarity of (query_id, vec)."""
        return feedback.familiarity(feedback.codes(rows.select("query_id", "vec")), self.trace())

    # --- retrieval
    def _queries(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")

    def search(self, *texts: str, k: int | None = None) -> DataFrame | None:
        """Hybrid search of texts; the session's last queries colour a single one. None while nothing is stored."""
        docs = self.store.documents()
        if docs is None:
            return None
        queries, model = self._queries(list(texts)), self.embedder()
        words = plans.parsed(queries).select("query_id", F.col("words").alias("text"))
        asked = model.embed(words).select("query_id", "vec")
        context = None
        if len(texts) == 1 and self.session:
            recent = [np.array(r.vec) for r in model.embed(self._queries(self.session[-3:])).orderBy("query_id").collect()]
            mixed = feedback.blended(recent, np.array(asked.first().vec))
            asked = self.spark.createDataFrame([(0, [float(v) for v in mixed])], "query_id long, vec array<float>")
            context = self._queries(self.session[-1:]).select("query_id", F.explode(F.array_distinct(T.norm_terms(F.col("text")))).alias("term"))
        journal, fixed, dan = self.journal(), None, None
        config = replace(self.settings.search, weights=self.weights(), **({"k": k} if k else {}))
        if journal is not None:
            signed = words.select("query_id", feedback.signature(F.col("text")).alias("sig"))
            fixed = feedback.corrections(journal).join(signed, "sig").select("query_id", "docid", "place")
            dan = feedback.doc_feedback(journal)
        lists = self.lists()
        vectors = self.vectors() if lists is None else self.listed()
        out = plans.search(queries, self.index(), vectors, asked, config, dan, fixed, self.gone(), context, lists)
        if len(texts) == 1 and texts[0].strip():
            self.session = [*self.session, plans.parse(texts[0]).words][-self.settings.session :]
        return out

    def answer(self, *texts: str) -> DataFrame | None:
        """query_id, zone, reply, type, answer, evidence by dense recall and extraction."""
        docs = self.store.documents()
        if docs is None:
            return None
        queries, model = self._queries(list(texts)), self.embedder()
        alive = live(self.vectors(), self.gone())
        found = plans.answer(queries, model.embed(queries).select("query_id", "vec"), alive, docs, self.settings.search)
        return answers.phrased(found)

    def recognise(self, photos: DataFrame) -> DataFrame:
        """query_id, label (species or null), score, margin, toxic, warn for photos (query_id, vec).

        The nearest documents that are photos count. A species that is not known to be harmless is warned of.
        """
        docs = live(self.store.documents(), self.gone())
        near = dense.of_kind(dense.topk(photos, live(self.vectors(), self.gone()), self.settings.photos), docs)
        scored = near.join(docs.select("docid", F.col("species").alias("label")), "docid")
        species = self.spark.read.parquet(f"{self.root}/species").groupBy("species").agg(F.max("toxic").alias("toxic"))
        return dense.recognise(scored, species.withColumnRenamed("species", "label"), self.settings.threshold, self.settings.margin)

    def citations(self, hits: DataFrame) -> DataFrame:
        docs = self.store.documents().select("docid", T.citation(F.col("source"), heading=F.col("heading"), page=F.col("page"), row=F.col("row"), line=F.col("line")).alias("citation"))
        return hits.join(docs, "docid")

    def find(self, text: str) -> int | None:
        """The first live document that contains the text or is contained in it."""
        docs = self.store.documents()
        row = None if docs is None else lexical.containing(self._queries([text]), live(docs, self.gone())).first()
        return row and row.docid

    def sources(self) -> DataFrame:
        return source_counts(live(self.store.documents(), self.gone()))

    def known_facts(self) -> DataFrame:
        """docid, text of what is neither buried nor forgotten."""
        return live(self.store.documents(), self.gone()).select("docid", "text")

    def new_topic(self) -> None:
        self.session = []

    # --- feedback
    def journal(self) -> DataFrame | None:
        fs, path = self.store._path("journal")
        return self.spark.read.parquet(str(path)) if fs.exists(path) else None

    def feedback(self, query: str, shown: list[int], picked: int, sign: int, conf: float = 0.5) -> None:
        """Appends an event; corrections, sums and activity derive from the journal. The same signature is used as in search.

        The trace learns the document or, the more so the surer the answer shown was (conf), unlearns it.
        """
        seq = 0 if (j := self.journal()) is None else j.agg(F.max("seq")).first()[0] + 1
        row = self.spark.createDataFrame([(seq, plans.parse(query).words, shown, picked, sign)], "seq long, q string, shown array<long>, picked long, sign int")
        row.withColumn("sig", feedback.signature(F.col("q"))).write.mode("append").parquet(f"{self.root}/journal")
        self._event(self.spark.createDataFrame([(picked, 1)], "docid long, nth long"), 1.0 if sign > 0 else -(0.5 + conf))
        if self.settings.online:
            self.learn()

    def gone(self) -> DataFrame:
        """docid of buried and inactive documents."""
        journal = self.journal()
        dead = self.store.tombstones().select("docid")
        return dead if journal is None else dead.unionByName(feedback.doc_state(journal).where("not active").select("docid")).distinct()

    def ranker(self) -> tuple[feedback.Ranker, int]:
        """The ranker as it stands, and the number of journal events it has learned from."""
        rows = self.store.load().get("ranker")
        row = rows and rows.first()
        if not row:
            return feedback.Ranker(), 0
        return feedback.Ranker(np.array(row.w), np.array(row.pair_count, np.int64), row.n_pairs), row.upto

    def weights(self) -> tuple[float, ...]:
        return tuple(float(w) for w in self.ranker()[0].w)

    def learn(self) -> tuple[float, ...]:
        """The ranker goes on from the events it has not seen, one by one and in order; its state is stored."""
        journal, (ranker, upto) = self.journal(), self.ranker()
        new = None if journal is None else journal.where((F.col("seq") >= upto) & (F.size("shown") > 0))
        if new is not None and (last := new.agg(F.max("seq")).first()[0]) is not None:
            asked = self.embedder().embed(new.select(F.col("seq").alias("query_id"), F.col("q").alias("text"))).select("query_id", "vec")
            features = materialise(plans.event_features(new, self.index(), self.vectors(), asked, self.settings.search, feedback.doc_feedback(journal)), "features")
            pairs = feedback.training_pairs(new, features).orderBy("seq", "docid").toLocalIterator()
            for _, event in itertools.groupby(pairs, key=lambda r: r.seq):  # one event at a time is on the driver
                ranker.learn(np.array([np.array(r.winner) - np.array(r.loser) for r in event]))
            state = [(ranker.w.tolist(), ranker.pair_count.tolist(), ranker.n_pairs, last + 1)]
            self.store.save(ranker=self.spark.createDataFrame(state, "w array<double>, pair_count array<long>, n_pairs long, upto long"))
        return tuple(float(w) for w in ranker.w)

    def consolidate(self) -> dict[str, int]:
        """Buries what feedback condemned, learns again what is shown but faint, refits when the store has grown; returns counts."""
        journal, out = self.journal(), {"forget": 0, "relearn": 0, "refit": 0}
        if journal is not None:
            concerned = feedback.shown_counts(journal).select("docid").unionByName(feedback.doc_feedback(journal).select("docid")).distinct()
            rows = self.vectors().join(concerned, "docid").select(F.col("docid").alias("query_id"), "vec")
            known = self.familiarity(rows).withColumnRenamed("query_id", "docid")
            actions = materialise(feedback.consolidation(journal, known), "actions")
            self.store.bury(actions.where("action = 'forget'"))
            out |= {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
            if out["relearn"]:
                again = actions.where("action = 'relearn'").orderBy("docid").rdd.zipWithIndex().map(lambda x: (x[0].docid, x[1] + 1))
                self._event(self.spark.createDataFrame(again, "docid long, nth long"), self.settings.relearn)
        model = self.embedder()
        if model is not None and self.store.size() > self.settings.refit_growth * max(1, model.n_fit):
            self._refit()
            self._list_up("all")
            out["refit"] = 1
        return out

    def bundle(self, target: str) -> Library:
        """The whole library copied to another folder, as it stands."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        source, copy = jvm.org.apache.hadoop.fs.Path(self.root), jvm.org.apache.hadoop.fs.Path(target)
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, conf)
        return Library(self.spark, target, self.settings)

    def health(self) -> dict[str, int]:
        docs, segments = self.store.documents(), len(self.store.manifest()["segments"])
        names = ("n_docs", "n_live", "n_images", "n_sources", "n_species")
        found = dict.fromkeys(names, 0) if docs is None else health(docs, self.gone()).first().asDict()
        return found | {"n_segments": segments}
