"""The stored library end to end: the life of a small collection."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwood.operators import feedback
from siftwood.operators.index import Index
from siftwood.plans.library import Library, Settings


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    root = tmp_path_factory.mktemp("shelf")
    (root / "in").mkdir()
    (root / "in" / "coast.md").write_text("# Маяк\nВ 1874 году смотритель Ефимов построил на мысе каменный маяк.\n# Пасека\nПчёлы собирают мёд с липы. Пасечник варит сладкий сбитень.")
    (root / "in" / "staff.csv").write_text("имя,роль\nАнна,ботаник\nПётр,механик\n", encoding="utf-8")
    return root


def test_life_of_a_collection(spark, shelf):
    lib = Library(spark, f"file://{shelf}/store")
    assert lib.search("что-нибудь") is None and lib.health()["n_docs"] == 0
    first = lib.index_path(str(shelf / "in"))
    assert first["files"] == 2 and first["added"] >= 4 and first["dups"] == 0
    assert lib.index_path(str(shelf / "in"))["added"] == 0

    hits = lib.search("каменный маяк на мысе").orderBy("place").collect()
    assert "маяк" in hits[0].text
    said = lib.citations(lib.search("ботаник")).orderBy("place").first().citation
    assert said.endswith("row 1")
    lib.new_topic()
    assert all("staff" not in r.citation for r in lib.citations(lib.search("source:coast Анна")).collect())

    lib.new_topic()
    query = "сладкий сбитень"
    best = lib.search(query).orderBy("place").collect()
    other = best[-1].docid
    lib.feedback(query, [r.docid for r in best], other, 1)
    lib.new_topic()
    assert lib.search(query).orderBy("place").first().docid == other
    lib.feedback(query, [other], other, -1)
    lib.new_topic()
    assert other not in {r.docid for r in lib.search(query).collect()}
    assert set(lib.consolidate()) == {"forget", "relearn", "refit"}
    assert lib.ranker()[1] == 2 and lib.ranker()[0].n_pairs > 0

    assert lib.memorize("Кактус цветёт ночью.") == 1
    assert lib.find("КАКТУС ЦВЕТЁТ") == lib.health()["n_docs"] - 1 and lib.find("нет такого") is None
    lib.new_topic()
    assert "Кактус" in lib.search("когда цветёт кактус").orderBy("place").first().text
    assert lib.remove_source("staff") >= 1
    again = Library(spark, f"file://{shelf}/store")
    assert "staff" not in "".join(r.source or "" for r in again.sources().collect())
    assert again.answer("кто построил каменный маяк?").first().zone in ("confident", "unsure", "ambiguous", "unknown")


def test_segments_add_up_to_one_index(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/s", Settings(online=False, refit_growth=100.0))
    texts = ["лодка плывёт по реке", "река течёт в море", "лодка и парус", "парус белеет в море", "море шумит"]
    for text in texts:
        assert lib.memorize(text) == 1
    found, whole = lib.index(), Index.build(lib.store.documents())
    rows = lambda df, *by: sorted(tuple(map(str, r)) for r in df.select(*by).collect())
    assert rows(found.lexicon, "term", "df") == rows(whole.lexicon, "term", "df")
    assert rows(found.postings, "term", "docid", "tf", "positions") == rows(whole.postings, "term", "docid", "tf", "positions")
    assert rows(found.corpus_stats, "n", "avgdl") == rows(whole.corpus_stats, "n", "avgdl")
    vectors = {r.docid: r.vec for r in lib.vectors().collect()}
    again = {r.docid: r.vec for r in lib.embedder().embed(lib.store.documents().select("docid", "text")).collect()}
    assert vectors.keys() == again.keys() and all(np.allclose(vectors[i], again[i], atol=1e-6) for i in again)
    # the trace is that of the documents in order
    coded = feedback.codes(lib.vectors()).withColumn("ordinal", F.col("docid") + 1).withColumn("amount", F.lit(1.0))
    want = {r.cell: r.w for r in feedback.trace(coded.select("ordinal", "vec", "cells", "amount"), lib.settings.decay).collect()}
    got = {r.cell: r.w for r in lib.trace().collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)
    before = {r.query_id: r.familiarity for r in lib.familiarity(lib.vectors().select(F.col("docid").alias("query_id"), "vec")).collect()}
    lib.feedback("море", [1, 3], 3, -1, conf=0.9)
    after = {r.query_id: r.familiarity for r in lib.familiarity(lib.vectors().select(F.col("docid").alias("query_id"), "vec")).collect()}
    assert after[3] < 0.5 * before[3] and after[2] > 0.7 * before[2] and after[0] > 0.9 * before[0]


def test_photos_are_recognised(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = {s: rng.normal(size=512) for s in ("Agaricus", "Russula", "Lactarius")}
    unit = lambda v: [float(x) for x in v / np.linalg.norm(v)]
    rows = []
    for species, card in (("Agaricus", "ядовит: нет. Растёт на лугу."), ("Russula", "ядовит: да. Шляпка красная."), ("Lactarius", "Млечный сок.")):
        folder = tmp_path / "in" / species
        folder.mkdir(parents=True)
        (folder / "card.md").write_text(card)
        for k in range(3):
            data = f"{species}{min(k, 1)}".encode()  # the last is a copy
            (folder / f"{k}.jpg").write_bytes(data)
            rows.append((hashlib.md5(data).hexdigest(), unit(centre[species] + 0.1 * rng.normal(size=512))))
    seen = spark.createDataFrame(rows, "digest string, vec array<double>")
    lib = Library(spark, f"file://{tmp_path}/s", Settings(online=False))
    added = lib.index_species(str(tmp_path / "in"), seen)
    assert added["images"] == 6 and added["species"] == 3 and added["cards"] == lib.health()["n_docs"] - 6
    assert lib.index_species(str(tmp_path / "in"), seen)["images"] == 0 and lib.health()["n_images"] == 6
    asked = spark.createDataFrame([(0, unit(centre["Agaricus"])), (1, unit(centre["Russula"])), (2, unit(centre["Lactarius"])), (3, unit(rng.normal(size=512)))], "query_id int, vec array<double>")
    got = {r.query_id: (r.label, r.toxic, r.warn) for r in lib.recognise(asked).collect()}
    assert got[1] == ("Russula", True, True) and got[2] == ("Lactarius", None, True) and got[0][0] == "Agaricus"
    assert got[3][0] is None and not got[3][2]


def test_lists_are_kept_for_many_documents(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/s", Settings(online=False, ivf_from=12, refit_growth=100.0))
    (tmp_path / "in").mkdir()
    words = "сосна берёза дуб клён липа ясень вяз осина ольха тополь ива рябина бук граб кедр пихта".split()
    (tmp_path / "in" / "t.txt").write_text(" ".join(f"Дерево {w} растёт у дома номер {i}." for i, w in enumerate(words)))
    lib.index_path(str(tmp_path / "in"))
    assert lib.lists() is not None and lib.listed().count() == lib.health()["n_docs"]
    lib.memorize("Сирень цветёт весной у калитки.")
    assert lib.listed().count() == lib.health()["n_docs"]
    lib.new_topic()
    assert "Сирень" in lib.search("когда цветёт сирень").orderBy("place").first().text
    lib.new_topic()
    assert "кедр" in lib.search("дерево кедр у дома").orderBy("place").first().text
