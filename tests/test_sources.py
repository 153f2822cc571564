"""Files, taxonomy, the segment store and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from siftwood.operators import ingest
from siftwood.sources import files, taxonomy
from siftwood.sources.store import Store, live
from siftwood.streaming import feeds


def test_folder_of_five_formats(spark, tmp_path):
    (tmp_path / "a.md").write_text("# H\nТекст один.")
    (tmp_path / "b.csv").write_text("имя,роль\nАнна,лаборант\n,пусто\n", encoding="utf-8")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\nbad\n{"b": "x"}\n')
    (tmp_path / "d.json").write_text('{"k": [1, {"z": true}]}')
    (tmp_path / "e.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "f.txt").write_text("no")
    (tmp_path / "g.bin").write_text("no")
    got = {(r.source.rsplit("/", 1)[1], r.row, r.line, r.text) for r in files.load(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.md", None, None, "# H\nТекст один."),
        ("b.csv", 1, None, "имя: Анна | роль: лаборант"),
        ("b.csv", 2, None, "роль: пусто"),
        ("c.jsonl", None, 1, '{"a": 1}'),
        ("c.jsonl", None, 4, '{"b": "x"}'),
        ("d.json", None, None, "k[0]: 1"),
        ("d.json", None, None, "k[1].z: True"),
        ("e.txt", None, None, "Привет"),
    }


def test_long_cells_and_broken_lines(spark):
    body = "name,note\n" + "x" * 140_000 + ",y\n" + '"open\n' + "a,b\n"
    rows = spark.createDataFrame([("p", "csv", body)], "path string, ext string, body string")
    got = {r.row: r.text for r in files.csv_rows(rows).collect()}
    assert got[1].endswith("| note: y") and len(got[1]) > 140_000 and got[3] == "name: a | note: b"


def test_species(spark, tmp_path):
    for name, card, image in (("Amanita", "ядовит: да", b"1"), ("Boletus", "ядовит: неизвестно", b"1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "card.md").write_text(card)
        (tmp_path / name / "x.jpg").write_bytes(image)
    cards, photos = files.species_folders(spark, str(tmp_path))
    assert {(r.species, r.toxic) for r in cards.collect()} == {("Amanita", True), ("Boletus", None)}
    once = files.new_images(photos)
    assert once.count() == 1 and files.new_images(photos, once).count() == 0


def test_taxonomy(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("name.tsv", "ID\tscientificName\tgenus\trank\nn1\tRosa alba\tRosa\tspecies\nn2\tRosa\t\tgenus\nn3\tRosaceae\t\tfamily\nn4\tLost one\tLost\tspecies\nn5\tx\t\tform\n")
        z.writestr("taxon.tsv", "ID\tnameID\tparentID\nt1\tn1\tt2\nt2\tn2\tt3\nt3\tn3\t\nt4\tn4\tt9\nt5\tn5\tt2\n")
    paths = taxonomy.unzip(str(tmp_path / "z.zip"), str(tmp_path))
    rows = taxonomy.backbone(taxonomy.read_tsv(spark, paths["name.tsv"]), taxonomy.read_tsv(spark, paths["taxon.tsv"]))
    assert {tuple(r) for r in rows.collect()} == {("t1", "Rosa alba", "Rosa", "Rosaceae"), ("t4", "Lost one", "Lost", "")}
    cards = taxonomy.skeletons(rows, "Rosaceae")
    assert taxonomy.write_skeletons(cards, str(tmp_path / "out")) == 1 and taxonomy.write_skeletons(cards, str(tmp_path / "out")) == 0
    assert "ядовит: неизвестно" in (tmp_path / "out" / "Rosa_alba" / "card.md").read_text()


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.documents() is None and store.tombstones().count() == 0
    rows = spark.createDataFrame([(f"t{i}", "a" if i < 7 else "b") for i in range(10)], "text string, source string")
    assert store.append(rows) == 10 and store.append(rows.where("source = 'b'")) == 3
    docs = store.documents()
    assert sorted(r.docid for r in docs.collect()) == list(range(13))
    assert store.remove_source("b") == 6 and store.remove_source("b") == 0
    assert live(docs, store.tombstones()).count() == 7
    store.save(lexicon=spark.createDataFrame([("x", 1)], "term string, df long"))
    store.save(lexicon=spark.createDataFrame([("y", 2)], "term string, df long"))
    again = Store(spark, f"file://{tmp_path}")
    assert again.load()["lexicon"].first().term == "y" and len(again.manifest()["segments"]) == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"seq": i, "q": "x", "shown": [1, 2], "picked": 1, "sign": 1}) for i in range(3)))
    seen = []
    stream = feeds.read_journal(spark, str(tmp_path / "in"))
    feeds.follow_journal(stream, str(tmp_path / "journal"), str(tmp_path / "ck"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert seen == [3] and spark.read.parquet(str(tmp_path / "journal")).count() == 3
    feeds.running_feedback(feeds.read_journal(spark, str(tmp_path / "in")), "sums").awaitTermination()
    assert spark.table("sums").first().feedback == 3
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("Один. Два. Три.")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        feeds.ingest_folder(spark, str(tmp_path / "docs"), store, str(tmp_path / "ck2"), ingest.chunks).awaitTermination()
    assert store.documents().count() == 2


def test_first_per_group(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("g"), "id")
    assert files.first_per_group(rows, "g", "id", 2).count() == 4
