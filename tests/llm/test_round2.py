"""Properties of the operators at sizes and on texts that the small fixtures don't reach."""

import random

import numpy as np
import pytest

pytest.importorskip("vakya.llm")
from vakya.llm import base, formatdup, leaks, looks  # noqa: E402


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_plain_forms_are_plain_and_those_of_their_clusters():
    t, r = looks.transducer(), random.Random(1)
    of = [(0x20, 0x7F), (0x300, 0x345), (0x391, 0x3D0), (0x400, 0x460), (0x900, 0x980), (0xC00, 0xC80), (0x1100, 0x11C3), (0x1F00, 0x1FFF), (0x3131, 0x3190), (0xAC00, 0xAC40), (0xFF01, 0xFFDD), (0x200B, 0x2010), (0x1D400, 0x1D420)]
    pool = [chr(c) for a, b in of for c in range(a, b)] + [*"\u00a0\u3000\u00b4\u1e9b\u0323\ufdfa\u3164\ufe0f\u0b47\u0b3e\u09c7\u09be"]
    for _ in range(20_000):
        x = "".join(r.choices(pool, k=r.randint(0, 9)))
        f = t.form(x)
        assert f == " ".join(t.plain(x).split()) and t.form(f) == f, [hex(ord(c)) for c in x]


def test_a_conflicting_table_is_refused(monkeypatch):
    monkeypatch.setitem(looks.LOOKALIKES, "a", "\u0430")  # the one makes the other and back: no output would be plain
    with pytest.raises(ValueError, match="conflict"):
        looks.Transducer()


def test_pairs_of_looks_with_a_hot_text(spark):
    data = [("d", k, "Moscow") for k in range(300)] + [("d", 300, "M\u043escow"), ("d", 301, "Mosc\u043ew"), ("e", 5, "M\u043escow")]
    df = spark.createDataFrame(data, "src string, key bigint, text string")
    got = rows(looks.same_look_pairs(df))
    assert got == sorted([("d", k, j) for k in range(300) for j in (300, 301)] + [("d", 300, 301)])
    assert {r["n_texts"] for r in looks.same_look_classes(df).where("src = 'd'").collect()} == {3}


def test_long_copies_lose_no_link(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(500)]
    records = [" ".join(r.choices(words, k=290)) for _ in range(100)]
    style = (str.upper, str.title, lambda x: x.replace(" ", ", "), lambda x: f" {x}! ", lambda x: x.replace(" ", "  "))
    posts = spark.createDataFrame([(k, style[k // 100 % 5](records[k % 100])) for k in range(6000)], "id bigint, text string").coalesce(1)
    assert sum(map(len, records)) * 60 > 10_000_000
    assert rows(formatdup.format_copies(posts)) == sorted((k % 100, k) for k in range(100, 6000))


def test_a_sieve_lets_all_members_pass(spark):
    df = spark.range(0, 10_000_000_000_000, 100_000_007)
    keep = base.Sieve(df.where("id % 10 = 0"), "id")
    got = {r[0] for r in keep.pass_through(df, "id").collect()}
    want = {r[0] for r in df.where("id % 10 = 0").collect()}
    assert want <= got and len(got) < 0.3 * df.count()
    assert base.Sieve(df.limit(0), "id").pass_through(df, "id").isEmpty()
    negative = spark.createDataFrame([(-5,), (2**62,)], "id bigint")
    assert rows(base.Sieve(negative, "id").pass_through(negative, "id")) == [(-5,), (2**62,)]


def test_a_shared_folder_is_demanded_on_several_machines():
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Sc:
                        getCheckpointDir = staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))

                    return Sc

    with pytest.raises(ValueError, match="share"):
        base.shared_dir(Session)


def test_items_in_blocks_and_by_their_rarest_terms(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(r.choices(words, k=r.randint(10, 40)))) for k in range(400)]
    docs = []
    for k in range(200):
        t = r.choices(words, k=120)
        for _ in range(3):
            item = r.choice(items)[1].split()
            n = r.randint(8, len(item))
            a = r.randint(0, len(item) - n)
            t[r.randint(0, 100) : 0] = item[a : a + n]
        docs.append((k, " ".join(t)))
    want = set()
    grams = {}
    for i, t in items:
        w = t.split()
        for a in range(len(w) - 12):
            grams.setdefault(tuple(w[a : a + 13]), set()).add(i)
    for d, t in docs:
        w = t.split()
        for a in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[a : a + 13]), ())}
    dd, di = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = rows(leaks.leaks(dd, di))
    assert {x[:2] for x in one} == want and len(want) > 100
    assert rows(leaks.leaks(dd, di, most=1000, shard=2000)) == one
    assert rows(leaks.near_leaks(dd, di, most=1000)) == rows(leaks.near_leaks(dd, di))
    assert leaks.leaks(dd, di.limit(0)).isEmpty()


def test_bits_of_a_large_sieve_are_bounded():
    s = base.Sieve.__new__(base.Sieve)
    s.bits, s.map = 1 << 16, np.zeros(8192, np.uint8)
    assert not s.may_hold(np.array([0, -1, 2**63 - 1])).any()
