import random

from conftest import people_frame
from pyspark.sql import functions as F

from tieweave.operators import changes as C
from tieweave.schema import PERSON
from tieweave.streaming import jobs as S

PATCH = "network_id string, person_id long, seq int, op string, name string, bio string, notes string, tags array<string>, skills array<string>, companies array<string>, cities array<string>, needs array<string>, is_wishlist boolean"


def log_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = "delete" if rng.random() < 0.1 else "put"
        maybe = lambda v: v if rng.random() < 0.4 else None
        rows.append(("n", rng.randint(2, 8), i, op, maybe(f"name{i}"), maybe(f"bio{i}"), maybe(f"note{i}"), maybe([f"t{i}"]), None, maybe([]), None, None, maybe(i % 2 == 0)))
    return rows


def replay(start, rows):
    """One change after the other."""
    fields = ["name", "bio", "notes", "tags", "skills", "companies", "cities", "needs", "is_wishlist"]
    state = {p["person_id"]: dict(zip(fields, [p["name"], None, None, p.get("tags", []), [], [], [], [], False])) for p in start}
    for r in sorted(rows, key=lambda r: r[2]):
        if r[3] == "delete":
            state[r[1]] = {}
        else:
            person = state.setdefault(r[1], {})
            person.update({f: v for f, v in zip(fields, r[4:]) if v is not None})
    return {k: (v["name"], v.get("bio"), v.get("notes"), v.get("tags") or [], bool(v.get("is_wishlist"))) for k, v in state.items() if v.get("name")}


def shown(df):
    return {r.person_id: (r.name, r.bio, r.notes, list(r.tags), r.is_wishlist) for r in df.collect()}


START = [{"person_id": 2, "name": "old2", "tags": ["s"]}, {"person_id": 3, "name": "old3"}]


def test_person_changes_equal_replay_and_compaction_keeps_the_meaning(spark):
    for seed in (1, 2):
        rows = log_rows(seed)
        log, people = spark.createDataFrame(rows, PATCH), people_frame(spark, START)
        want = replay(START, rows)
        assert shown(C.apply_person_patches(people, log)) == want
        halves = S.compact_patches(log.filter("seq < 60")).unionByName(S.compact_patches(log.filter("seq >= 60")))
        assert shown(C.apply_person_patches(people, S.compact_patches(halves))) == want


def test_streamed_edges_equal_batch_over_several_batches_and_replays(spark, tmp_path):
    schema = "network_id string, source_id long, target_id long, strength int, context string, frequency string, source string, seq int"
    rng = random.Random(9)
    rows = [("n", rng.randint(1, 3), rng.randint(4, 6), rng.randint(1, 5), f"c{i}", "yearly", rng.choice(["manual", "ai_inferred", "colleague_inferred"]), i) for i in range(120)]
    rng.shuffle(rows)  # late rows
    for i in range(0, 120, 20):
        spark.createDataFrame(rows[i : i + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    S.edge_stream(source, f"{tmp_path}/state", f"{tmp_path}/cp", compact_every=4).awaitTermination()
    got = S.state(spark, f"{tmp_path}/state", S.fold_edges)
    want = S.fold_edges(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    S.edge_stream(source, f"{tmp_path}/state", f"{tmp_path}/cp2", compact_every=4).awaitTermination()  # replay into the same folders
    assert sorted(map(tuple, S.state(spark, f"{tmp_path}/state", S.fold_edges).collect())) == sorted(map(tuple, want.collect()))


def test_ticket_numbers_go_on(spark):
    t = spark.createDataFrame([("2026-04-23 10:00:00", 1), ("2026-04-23 11:00:00", 2), ("2026-04-24 00:00:00", 3)], "ts string, seq int").withColumn("ts", F.to_timestamp("ts"))
    old = spark.createDataFrame([("FB-20260423-0041",)], "ticket_id string")
    assert [r.ticket_id for r in C.number_tickets(t, old).orderBy("seq").collect()] == ["FB-20260423-0042", "FB-20260423-0043", "FB-20260424-0001"]
    assert C.number_tickets(t).filter("seq = 1").first().ticket_id == "FB-20260423-0001"


def test_owner_is_created_once(spark):
    people = people_frame(spark, [{"person_id": 1, "is_me": True}])
    wanted = spark.createDataFrame([("n", 1, 5, "x", None), ("m", 2, 6, "late", None), ("m", 1, 7, "first", None)], "network_id string, seq int, person_id long, name string, bio string")
    rows = C.ensure_owner(people, wanted).filter("is_me").orderBy("network_id").collect()
    assert [(r.network_id, r.name) for r in rows] == [("m", "first"), ("n", "p1")]
    assert set(PERSON.fieldNames()) == set(C.ensure_owner(people, wanted).columns)


def test_a_table_streams_as_one_file_and_as_a_folder_of_parts(spark, tmp_path):
    from pyspark.sql import functions as F

    from tieweave.sources.testbed import raw_stream
    from tieweave.streaming.jobs import write_scrubbed

    folder, single = tmp_path / "folder", tmp_path / "single"
    rows = spark.range(30).select(F.col("id").alias("conv_id"), F.concat(F.lit("a@b"), "id", F.lit(".org")).alias("text")).repartition(3)
    rows.write.parquet(str(folder / "conversations.parquet"))
    rows.toPandas().to_parquet((single.mkdir(), single / "conversations.parquet")[1])
    for sf in (folder, single):
        write_scrubbed(raw_stream(spark, str(sf), "conversations"), ["text"], f"{sf}/out", f"{sf}/checkpoint").awaitTermination()
        assert {r.text for r in spark.read.parquet(f"{sf}/out").collect()} == {f"a***@b{i}.org" for i in range(30)}
