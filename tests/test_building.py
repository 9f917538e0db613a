import pytest
from conftest import edge_frame, people_frame
from pyspark.sql import functions as F

from tieweave.functions import values as V
from tieweave.plans.building import build_network
from tieweave.sources import contacts as C

OWNER = [{"person_id": 1, "is_me": True, "name": "Me"}]


def sheet(spark, rows, columns):
    schema = "network_id string, seq long, " + ", ".join(f"`{c}` string" for c in columns)
    df = spark.createDataFrame([("n", i, *r) for i, r in enumerate(rows)], schema)
    return C.clean_profiles(C.normalise_headers(df)[0])


def built(spark, rows, columns, **kw):
    out = build_network(sheet(spark, rows, columns), people_frame(spark, OWNER), **kw)
    people = {r["name"]: r for r in out.people.collect()}
    ids = {r["person_id"]: n for n, r in people.items()}
    edges = {(ids[r.source_id], ids[r.target_id]): r for r in out.edges.collect()}
    return people, edges, out


def test_duplicate_names_add_up(spark):
    people, edges, _ = built(
        spark, [("张三", "金融，投资", "A公司", "3", "first"), ("张三", "投资、科技", None, "5", "-")], ["姓名", "所属行业", "公司", V.H_STRENGTH, "备注"]
    )
    assert len(people) == 2
    assert people["张三"].tags == ["金融", "投资", "科技"] and people["张三"].companies == ["A公司"] and people["张三"].notes == "first"
    assert edges["Me", "张三"].strength == 5


def test_zero_strength_is_a_wish_and_stays_one(spark):
    people, edges, _ = built(spark, [("A", "0"), ("B", ""), ("A", "2"), ("C", "4"), ("C", "0")], ["姓名", V.H_STRENGTH])
    assert people["A"].is_wishlist and people["C"].is_wishlist and not people["B"].is_wishlist
    assert {k: e.strength for k, e in edges.items()} == {("Me", "A"): 2, ("Me", "B"): 3, ("Me", "C"): 4}


def test_peers_first_mention_wins_and_unknown_ones_are_told(spark):
    rows = [("A", "B(4,同学)；Zed", "X"), ("B", "A(1)；B", "X"), ("C", "A(2)", "Y")]
    people, edges, out = built(spark, rows, ["姓名", "认识", "公司"])
    assert (edges["A", "B"].strength, edges["A", "B"].context, edges["A", "B"].source) == (4, "同学", "manual")
    assert edges["A", "C"].strength == 2
    assert [(r.name, r.peer) for r in out.unresolved.collect()] == [("A", "Zed")]
    stats = out.stats.first()
    assert (stats.people, stats.peer_edges, stats.colleague_edges) == (3, 2, 1)


def test_relation_sheet_last_row_wins_and_beats_the_column(spark):
    rel = spark.createDataFrame([("n", 1, "A", "B", "1", "old", "w"), ("n", 2, "B", "A", "9", "new", "每季"), ("n", 3, "A", "A", "2", None, None)],
                                "network_id string, seq long, `甲` string, `B` string, strength string, context string, frequency string")
    _, edges, _ = built(spark, [("A", "B(2)"), ("B", None)], ["姓名", "认识"], relations=C.read_relations(rel))
    e = edges["A", "B"]
    assert (e.strength, e.context, e.frequency) == (5, "new", "quarterly")


def test_headers_are_matched_loosely_and_unknown_columns_reported(spark):
    df = spark.createDataFrame([("n", 1, "A", "4", "x", "7", "5")], "network_id string, seq long, `　姓 名　` string, `可信度（言行一致性 0-5分）` string, `秘密` string, `合作价值评分（0-5）` string, `合作价值（0-5）` string")
    renamed, _ = C.normalise_headers(df)
    row = C.clean_profiles(renamed).first()
    assert (row.name, row.strength, row.bio) == ("A", 4, "合作价值：7/5")
    assert {r.column_name: r.filled for r in C.ignored_columns(renamed).collect()} == {"秘密": 1}


def test_missing_name_column(spark):
    with pytest.raises(ValueError):
        sheet(spark, [("A",)], ["公司"])


def test_contact_file_replaces_people(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,bio,tags,strength,frequency,extra\nAnn,first,a;b,5,weekly,x\nBob,,,,,\nAnn,,c,x,often,\n ,no name,,,,\n", encoding="utf-8")
    rows = C.clean_contacts(C.read_table(spark, str(tmp_path)).withColumn("network_id", F.lit("n")))
    out = build_network(rows, people_frame(spark, OWNER), mode="replace", colleagues=False)
    people = {r["name"]: r for r in out.people.collect()}
    assert sorted(people) == ["Ann", "Bob", "Me"]
    assert people["Ann"].bio is None and people["Ann"].tags == ["c"]
    assert [people[n].person_id for n in ("Ann", "Bob")] == [2, 3]
    assert {(r.target_id, r.strength, r.frequency) for r in out.edges.collect()} == {(2, 3, "yearly"), (3, 3, "yearly")}


def test_import_into_a_known_network_keeps_ids_and_hand_made_edges(spark):
    known = people_frame(spark, [*OWNER, {"person_id": 7, "name": "A", "tags": ["old"], "companies": ["X"]}])
    old = edge_frame(spark, [(7, 8, 2, "kept")])
    rows = sheet(spark, [("A", "新", "X", "0"), ("B", "b", "X", "0")], ["姓名", "所属行业", "公司", V.H_STRENGTH])
    out = build_network(rows, known, edges=old)
    people = {r["name"]: r for r in out.people.collect()}
    assert people["A"].person_id == 7 and people["A"].tags == ["old", "新"] and people["B"].person_id == 8
    assert [(r.source_id, r.target_id, r.strength, r.source) for r in out.edges.collect()] == [(7, 8, 2, "manual")]


def test_alias_rule_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"B ": [" x", "", 3], "A": ["y"], "C": "no list"}', encoding="utf-8")
    rows = C.read_alias_rules(spark, str(tmp_path)).orderBy("group_ord", "member_ord").collect()
    assert [(r.canonical, r.alias) for r in rows] == [("B", "x"), ("B", "3"), ("A", "y")]


def test_import_keeps_namesakes_and_strangers(spark):
    known = people_frame(spark, [*OWNER, {"person_id": 2, "name": "Ann", "tags": ["x"]}, {"person_id": 3, "name": "Ann", "tags": ["y"]}, {"person_id": 4, "name": "Bo"}])
    out = build_network(sheet(spark, [("Cy", "2"), ("Ann", "4")], ["姓名", V.H_STRENGTH]), known, colleagues=False)
    people = {r.person_id: r for r in out.people.collect()}
    assert {i: r.name for i, r in people.items()} == {1: "Me", 2: "Ann", 3: "Ann", 4: "Bo", 5: "Cy"}
    assert people[2].tags == ["x"] and people[3].tags == ["y"]
    assert {(r.source_id, r.target_id, r.strength) for r in out.edges.collect()} == {(1, 2, 4), (1, 5, 2)}


def test_known_edges_keep_id_and_introducer_and_new_ones_follow(spark):
    known = people_frame(spark, [*OWNER, {"person_id": 7, "name": "A"}, {"person_id": 8, "name": "B"}])
    old = edge_frame(spark, [(1, 7, 2, "kept"), (7, 8, 1)]).withColumn("introduced_by_id", F.when(F.col("edge_id") == 1, 8).cast("long"))
    out = build_network(sheet(spark, [("A", "5"), ("D", "1")], ["姓名", V.H_STRENGTH]), known, edges=old, colleagues=False)
    got = {(r.source_id, r.target_id): (r.edge_id, r.introduced_by_id, r.strength) for r in out.edges.collect()}
    assert got == {(1, 7): (1, 8, 5), (7, 8): (2, None, 1), (1, 9): (3, None, 1)}


def test_refused_strengths_are_returned_and_not_stored(spark):
    rows = spark.createDataFrame([("n", 1, "A", "9"), ("n", 2, "B", "0"), ("n", 3, "C", "4")], "network_id string, seq long, name string, strength string")
    out = build_network(C.clean_contacts(rows), people_frame(spark, OWNER), colleagues=False)
    assert {r.name for r in out.people.collect()} == {"Me", "C"} and [r.strength for r in out.edges.collect()] == [4]
    assert {(r.name, r.strength) for r in out.refused.collect()} == {("A", 9), ("B", 0)}


def test_last_contact_is_that_of_the_write_that_won(spark):
    import datetime

    day = datetime.date(2024, 5, 1)
    schema = "network_id string, seq long, `甲` string, `B` string, strength string, last_contact string"
    rel = spark.createDataFrame([("n", 1, "A", "B", "1", "2024-01-01"), ("n", 2, "B", "A", "2", " 2024-05-01 "), ("n", 3, "A", "C", "2", "soon")], schema)
    people, edges, out = built(spark, [("A", "B(2)", "X"), ("B", None, "X"), ("C", None, "X")], ["姓名", "认识", "公司"], relations=C.read_relations(rel))
    assert edges["A", "B"].last_contact == day and edges["A", "C"].last_contact is None
    assert edges["Me", "A"].last_contact is None and edges["B", "C"].last_contact is None
    again = lambda **kw: build_network(sheet(spark, [("A", "4")], ["姓名", V.H_STRENGTH]), out.people, out.edges, **kw).edges.filter("source_id > 1")
    kept = {r.last_contact for r in again().filter("strength = 2 and last_contact is not null").collect()}
    assert kept == {day}
    newer = spark.createDataFrame([("n", 9, "A", "B", "3", None)], schema)
    rows = again(relations=C.read_relations(newer)).filter("strength = 3").collect()
    assert [r.last_contact for r in rows] == [None]


def test_contact_files_tell_days(spark):
    raw = spark.createDataFrame([("n", 1, "A", "2024-05-01"), ("n", 2, "B", "x"), ("n", 3, "C", None)], "network_id string, seq long, name string, last_contact string")
    assert [str(r.last_contact) for r in C.clean_contacts(raw).orderBy("seq").collect()] == ["2024-05-01", "None", "None"]
    assert "last_contact" not in C.clean_contacts(raw.drop("last_contact")).columns
