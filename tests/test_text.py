import pytest
from conftest import people_frame
from pyspark.sql import functions as F

from tieweave.functions import people as Q, text as X
from tieweave.operators import pseudonyms as N


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.o for r in df.select("i", column(F.col("c")).alias("o")).orderBy("i").collect()]


def test_scrub(spark):
    got = each(spark, X.scrub, [
        "call 13812348888 now", "id 11010519900307123X", "card 6222021234567890123", "mail alice.b@mail.example.com",
        "身份证 110105199003071234，手机 13900001111", "nothing here 12345", None, "手机13812348888",
    ])
    assert got == [
        "call 138****8888 now", "id [REDACTED_ID]", "card [REDACTED_CARD]", "mail a***@mail.example.com",
        "身份证 [REDACTED_ID]，手机 139****1111", "nothing here 12345", "", "手机13812348888",
    ]


def test_peer_entries(spark):
    got = each(spark, X.peer_entry, ["建国哥(4,大学同学)", "王毅", "李四（9，同事，3）", "赵六(老乡)", "a,b", "钱(00,x)"])
    assert [None if g is None else (g.name, g.strength, g.context) for g in got] == [
        ("建国哥", 4, "大学同学"), ("王毅", None, None), ("李四", 5, "同事/3"), ("赵六", None, "老乡"), None, ("钱", 1, "x"),
    ]


def test_strengths(spark):
    assert each(spark, X.strength_0_5, ["0", "", None, "x", "9", "-2", "3.0", "00000000000000000004", "123456789012345678901"]) == [0, 3, 3, 3, 5, 0, 3, 4, 5]


def test_split_multi(spark):
    assert each(spark, X.split_multi, ["a,b，c、d;e；f/g／h|i｜ j ", " ", None]) == [list("abcdefghij"), [], []]


def test_bio_pairs(spark):
    got = each(spark, X.bio_pairs, ["行业：金融 · 城市: 上海", "行业：金融", "行业：金融 · 没有冒号", None])
    assert [(p.key, p.value) for p in got[0]] == [("行业", "金融"), ("城市", "上海")]
    assert got[1:] == [None, None, None]


def test_industry_takes_the_first_bucket(spark):
    rows = people_frame(spark, [{"person_id": 1, "tags": ["私募"], "bio": "算法"}, {"person_id": 2, "bio": "Credit"}, {"person_id": 3}])
    assert [r.x for r in rows.select("person_id", Q.industry().alias("x")).orderBy("person_id").collect()] == ["投资金融", "技术研发", "其他"]


PEOPLE = [
    {"person_id": 1, "is_me": True, "name": "我主"},
    {"person_id": 2, "name": "张三", "companies": ["国信证券"]}, {"person_id": 3, "name": "李四", "companies": ["国信证券深圳", "A+B(x)"]},
    {"person_id": 4, "name": "Bob"},
]


def hide(spark, texts, **kw):
    names = N.dictionary(people_frame(spark, PEOPLE))
    df = spark.createDataFrame([("n", i, t) for i, t in enumerate(texts)], "network_id string, id int, text string")
    hidden = N.pseudonymise(df, names, ["network_id"], ["id"], **kw)
    back = N.restore(hidden, names, ["network_id"], ["id"])
    return [r.text for r in hidden.orderBy("id").collect()], [r.text for r in back.orderBy("id").collect()]


def test_pseudonyms_and_back(spark):
    texts = ["张三 在 国信证券深圳 见 李四", "Bobby met Bob", "在A+B(x)，我主", None, "无", "P999 C777"]
    hidden, back = hide(spark, texts)
    assert hidden == ["P002 在 C002 见 P003", "Bobby met P001", "在C001，P000", None, "无", "P999 C777"]
    # A token written directly after a letter of any script is no longer recognised.
    assert back == ["张三 在 国信证券深圳 见 李四", "Bobby met Bob", "在C001，我主", None, "无", "P999 C777"]


def test_adjacent_names_do_not_leak(spark):
    assert hide(spark, ["张三李四"])[0] == ["P002P003"]
    assert hide(spark, ["张三李四"], leak_safe=False)[0] == ["P002李四"]


def test_tokens_beyond_three_digits_restore(spark):
    rows = [{"person_id": 0, "is_me": True, "name": "me"}] + [{"person_id": i, "name": f"name{i:05d}"} for i in range(1, 1203)]
    names = N.dictionary(people_frame(spark, rows))
    df = spark.createDataFrame([("n", 1, "P1202 knows P001")], "network_id string, id int, text string")
    assert N.restore(df, names, ["network_id"], ["id"]).first().text == "name01202 knows name00001"


@pytest.mark.parametrize("names,between,want", [
    (["A", "B"], False, "下一步：直接联系 B。"), (["A", "M", "B"], False, "下一步：找 M，请他引荐 B。"),
    (["A", "M", "N", "B"], True, "沿 M → N 链路居间引荐 A ↔ B。"), (["A"], True, ""),
])
def test_next_step(spark, names, between, want):
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(Q.next_step(F.col("n"), between)).first()[0] == want
