"""The operators of the data problems against plain versions, with nulls, ties, repeats, empty tables and extra columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import hierarchy, hotkeys, orphans, packed, periods
from strandline.sources import gff3_rows
from tests import plain


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1
def test_top_k(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, *range(6)]), rnd.choice([None, *range(300)]), "x") for _ in range(4000)]
    df = spark.createDataFrame(data, "seqid string, effective_length bigint, locus_id bigint, key string").repartition(5)
    want = []
    for k in {d[0] for d in data} - {None}:
        c = sorted({(-e, i) for q, e, i, _ in data if q == k and e is not None and i is not None})[:3]
        want += [(k, i) for _, i in c]
    for fold, table in ((10, 5), (100_000, 100_000)):
        got = hotkeys.top_k_per_key(df, "seqid", "effective_length", "locus_id", 3, fold_rows=fold, table_rows=table)
        assert rows(got) == sorted(want, key=str)


def test_top_k_doubles_and_empty(spark):
    df = spark.createDataFrame([("a", 1.5, 1), ("a", float("nan"), 2), ("a", -2.0, 3), ("b", None, 4)], "k string, v double, i int")
    assert rows(hotkeys.top_k_per_key(df, "k", "v", "i", 2)) == [("a", 1), ("a", 3)]
    assert rows(hotkeys.top_k_per_key(df.where("false"), "k", "v", "i", 2)) == []
    assert rows(hotkeys.rollup_per_key(df, "k", n=F.count("v"))) == [("a", 3), ("b", 0)]


# 2
def _links(data):
    nodes = {(f, i) for f, i, _, _ in data if i is not None}
    return nodes, {((f, i), (f, v)) for f, i, p, _ in data if i is not None for v in plain.packed_values(p) if (f, v) in nodes}


@pytest.mark.parametrize("group_rows", [1_000_000, 0])
def test_hierarchy(spark, group_rows):
    rnd = random.Random(7)
    data = [("f", None, "a", 0), ("f", "", None, 0), (None, "a", "b", 0), (None, "b", None, 0), ("h", "self", "self", 0), ("h", "x y", "'x y';self", 0)]
    for f, n in (("f", 60), ("g", 25)):
        for i in range(n):
            p = [f"n{rnd.randrange(max(0, i - 6), i)}" for _ in range(rnd.choice([1, 1, 2]))] if i and rnd.random() < 0.9 else []
            if rnd.random() < 0.06:
                p.append(f"n{min(n - 1, i + rnd.randrange(5))}")
            data.append((f, f"n{i}", rnd.choice([",", " | ", ";"]).join([*p, "nowhere"]) if p else None, i))
    data += data[:30]
    df = spark.createDataFrame(data, "file_id string, id string, parent string, depth int").repartition(3)
    nodes, links = _links(data)
    key = {x: f"{x[0]}/{x[1]}" for x in nodes}
    want = sorted((c, r, k) for c, r, k in plain.hierarchy({(key[c], key[p]) for c, p in links}, set(key.values())))
    got = [(f"{r.file_id}/{r.feature_id}", f"{r.file_id}/{r.root_id}", r.depth) for r in hierarchy.depths(df, "file_id", "id", "parent", group_rows=group_rows).collect()]
    assert sorted(got) == want
    assert rows(hierarchy.depths(df.where("false"), "file_id", "id", "parent", group_rows=group_rows)) == []


@pytest.mark.parametrize("group_rows", [1_000_000, 0])
def test_nested_sets(spark, group_rows):
    data = [("f", "r", None), ("f", "a", "r"), ("f", "b", "r,a"), ("f", "c", "b"), ("f", "z", "z")]
    df = spark.createDataFrame(data, "file_id string, id string, parent string")
    sets = hierarchy.nested_sets(df, "file_id", "id", "parent", group_rows=group_rows).collect()
    assert sorted(s.path for s in sets) == ["r", "r>a", "r>a>b", "r>a>b>c", "r>b", "r>b>c"]
    for x in sets:
        below = sum(x.lft < y.lft <= x.rgt for y in sets)
        assert below == x.n_below == sum(y.path.startswith(x.path + ">") for y in sets)
    got = hierarchy.descendants(df, "file_id", "id", "parent", group_rows=group_rows)
    assert rows(got) == [("f", "a", "b", 1), ("f", "a", "c", 2), ("f", "b", "c", 1), ("f", "r", "a", 1), ("f", "r", "b", 1), ("f", "r", "c", 2)]


def test_dense_chains_by_joins(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "UNFOLD", 0.001)
    data = [("f", "r", None), ("f", "a", "r"), ("f", "b", "r,a"), ("f", "c", "b,a")]
    df = spark.createDataFrame(data, "file_id string, id string, parent string")
    want = [("f", "a", "r", 1), ("f", "b", "r", 2), ("f", "c", "r", 3), ("f", "r", "r", 0)]
    assert rows(hierarchy.depths(df, "file_id", "id", "parent", group_rows=0)) == want


def test_dense_chains():
    import numpy as np

    child, parent = [], []
    for k in range(40):  # 2 ** 40 chains
        a, b, c, d = 3 * k, 3 * k + 1, 3 * k + 2, 3 * k + 3
        child += [b, c, d, d]
        parent += [a, a, b, c]
    f = hierarchy.Forest(121, np.array(child), np.array(parent))
    node, root, depth = f.depths()
    assert len(node) == 121 and set(root.tolist()) == {0} and depth.max() == 80
    up, down, far = hierarchy._reached(f)
    assert len(up) == sum(len(np.flatnonzero(f.level > k)) for k in f.level.tolist()) and far.max() == 80
    small = hierarchy.Forest(4, np.array([1, 2, 2, 3]), np.array([0, 0, 1, 2]))
    assert sorted(zip(*(x.tolist() for x in hierarchy._reached(small)))) == [(0, 1, 1), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1)]


@pytest.mark.parametrize("group_rows", [10, 1_000_000])
def test_paths_of_a_dense_scope_are_null(spark, group_rows):
    ladder = [("dense", f"n{k}.{i}", ",".join(f"n{k - 1}.{j}" for j in range(4)) if k else None) for k in range(10) for i in range(4)]
    df = spark.createDataFrame([*ladder, ("thin", "a", None), ("thin", "b", "a")], "file_id string, id string, parent string")
    got = hierarchy.nested_sets(df, "file_id", "id", "parent", group_rows=group_rows).collect()
    assert sorted((r.feature_id, r.depth, r.path) for r in got if r.file_id == "thin") == [("a", 0, "a"), ("b", 1, "a>b")]
    dense = [r for r in got if r.file_id == "dense"]
    assert {r.path for r in dense} == {r.lft for r in dense} == {None}
    assert {(r.feature_id, r.root_id, r.depth) for r in dense} == {(f"n{k}.{i}", f"n0.{j}", k) for k in range(10) for i in range(4) for j in range(4) if k or i == j} and len(dense) == 4 + 9 * 16


def _sets(data):
    """Every chain from a root, by recursion: (file, node, root, depth, path, lft, rgt, number below)."""
    nodes, links = _links([(*d, 0) for d in data])
    kids = {}
    for c, p in links:
        kids.setdefault(p, []).append(c)
    out, last = [], {}

    def down(x, way):
        f = x[0]
        at = last[f] = last.get(f, 0) + 1
        for k in sorted(kids.get(x, ()), key=lambda k: k[1].encode()):
            down(k, [*way, k[1]])
        out.append((f, x[1], way[0], len(way) - 1, ">".join(way), at, last[f], last[f] - at))

    for x in sorted(nodes - {c for c, _ in links}, key=lambda x: x[1].encode()):
        down(x, [x[1]])
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [0, 1_000_000])
def test_paths_at_any_density(spark, group_rows):
    """With and without more than UNFOLD chains a node, in one task or by joins: every chain, and the same ranges."""
    rnd = random.Random(3)
    data = [("dense", f"n{k}.{i}", ",".join(f"n{k - 1}.{j}" for j in range(4)) if k else None) for k in range(8) for i in range(4)]
    data += [(None, f"{'é' if i % 3 else 'Z'}{i}", None) for i in range(5)] + [("thin", f"x{i}", f"x{rnd.randrange(i)};x{rnd.randrange(i)}" if i > 2 else None) for i in range(30)]
    data += [("thin", "on", "on"), ("thin", "below", "on"), ("round", "a", "b"), ("round", "b", "a")]
    rnd.shuffle(data)
    want = _sets(data)
    assert sum(w[0] == "dense" for w in want) == sum(4**k for k in range(1, 9)) > hierarchy.UNFOLD * 1000
    df = spark.createDataFrame(data, "file_id string, id string, parent string").repartition(3)
    assert rows(hierarchy.nested_sets(df, "file_id", "id", "parent", group_rows=group_rows)) == want


def test_paths_come_in_batches(monkeypatch):
    import numpy as np

    names = [f"n{i:03}" for i in range(121)]
    diamonds = [(3 * k + c, 3 * k + p) for k in range(40) for c, p in ((1, 0), (2, 0), (3, 1), (3, 2))]
    f = hierarchy.Forest(121, *(np.array(x) for x in zip(*diamonds)))
    node, root, depth, lft, below, path = next(f.walk(names))  # of 2 ** 42 chains the first are there at once
    assert 0 < len(node) <= hierarchy.BATCH_ROWS and lft[0] == 1 and lft[-1] == len(node) and set(root.tolist()) == {0}
    assert below[0] == 2**42 - 4 and path[2].as_py() == "n000>n001>n003" and depth[2] == 2
    monkeypatch.setattr(hierarchy, "BATCH_BYTES", 30)
    small = hierarchy.Forest(4, np.array([1, 2, 2, 3]), np.array([0, 0, 1, 2]))
    got = list(small.walk(names))
    assert [p for b in got for p in b[5].to_pylist()] == ["n000", "n000>n001", "n000>n001>n002", "n000>n001>n002>n003", "n000>n002", "n000>n002>n003"]
    assert len(got) > 2 and np.concatenate([b[3] for b in got]).tolist() == [1, 2, 3, 4, 5, 6]
    more = hierarchy.Forest(181, *(np.array(x) for x in zip(*[(3 * k + c, 3 * k + p) for k in range(60) for c, p in ((1, 0), (2, 0), (3, 1), (3, 2))])))
    with pytest.raises(OverflowError):
        next(more.walk(names * 2))


# 3
LINES = [
    None, "", "   ", "#c\tx", "\r", "##gff-version 3",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a\r",
    "s\tx\tgene\t1\t2\t.\t+\t.",
    "s x gene 1 2 . + . ID=a",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a\t",
    's\t"x"\tgene\t1\t2\t.\t+\t.\tID=a',
    's\tx\tgene\t1\t2\t.\t+\t.\tID=a;Note="b; c=d";x=y',
    's\tx\tgene\t1\t2\t.\t+\t.\tNote="say ""hi"""',
    's\tx\tgene\t1\t2\t.\t+\t.\tNote="say "hi""',
    's\tx\tgene\t1\t2\t.\t+\t.\tNote="open;ID=a',
    's\tx\tgene\t1\t2\t.\t+\t.\tNote=ab"c;ID=a',
    's\tx\tgene\t1\t2\t.\t+\t.\t"Note"=a',
    "s\tx\tgene\t1\t2\t.\t+\t.\t.",
    "s\tx\tgene\t1\t2\t.\t+\t.\t",
    "s\tx\tgene\t1\t2\t.\t+\t.\t;;",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a;; b=c ;",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a;=lost",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a;lost",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a;b=",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a%2C",
    "s\tx\tgene\t1\t2\t.\t+\t.\tID=a%2",
    "s\tx\tgene\t1\t2\t.\t+\t.\taccession=QM_1.2",
    "s\tx\tgene\t1\t2\t.\t+\t.\taccession=QM_1",
    "s\tx\tgene\t1\t2\t.\t+\t.\taccession=QM-1.2;ID=b",
    "s\tx\tgene\t0\t2\t.\t+\t.\tID=a",
    "s\tx\tgene\t3\t2\t.\t+\t.\tID=a",
    "s\tx\tgene\t10\t9\t.\t+\t.\tID=a",
    "s\tx\tgene\t007\t00010\t.\t+\t.\tID=a",
    "s\tx\tgene\t1\t99999999999999999999999\t.\t+\t.\tID=a",
    "s\tx\tgene\t\t2\t.\t+\t.\tID=a",
    "s\tx\tgene\t1.0\t2\t.\t+\t.\tID=a",
    "s\tx\tgene\t1\t2\t1e-5\t?\t.\tID=a",
    "s\tx\tgene\t1\t2\t1,5\t+\t.\tID=a",
    "s\tx\tgene\t1\t2\t-3.25\t*\t.\tID=a",
    "s\tx\tgene\t1\t2\t.\t+\t3\tID=a",
    "s\tx\tCDS\t1\t2\t.\t+\t.\tID=a",
    "s\tx\tCDS\t1\t2\t.\t+\t0\tID=a",
    "s\tx\tgene\t1\t20\r\t.\t+\t.\tID=a",
    "s\tx\tgene\t1\t20\n\t.\t+\t.\tID=a",
    "s\tx\tgene\t1\n\t20\t.\t+\t.\tID=a",
    "s\tx\tgene\t1\t2\t1.5\n\t+\t.\tID=a",
    "s\tx\tgene\t1\t2\t.\t+\t.\taccession=AB_1.1\u0085",
    's\tx\tgene\t1\t2\t.\t+\t.\taccession="AB_1.1\n"',
    's\tx\tgene\t1\t2\t.\t+\t.\taccession="AB_1.1";ID="b"',
    's\tx\tgene\t1\t2\t.\t+\t.\taccession="AB-1.1";ID="b"',
    's\tx\tgene\t1\t2\t.\t+\t.\tID="";x=y',
    's\tx\tgene\t1\t2\t.\t+\t.\tID="a=b;c";lost',
    's\tx\tgene\t1\t2\t.\t+\t.\tNote="' + "x; " * 20_000 + '"',
    "s\tx\tgene\t1\t2\t.\t+\t.\t" + "ID=a;" * 20_000 + "%zz",
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(LINES)], "line_id bigint, line string, errors string").repartition(3)
    want = sorted((i, r) for i, x in enumerate(LINES) if (r := plain.line_reason(x)))
    assert rows(gff3_rows.rejected(df, "line_id")) == sorted(want, key=str)
    sound = {i for i, x in enumerate(LINES) if plain.line_reason(x) is None}
    got = gff3_rows.loaded(df, ["line_id"]).collect()
    assert {r.line_id for r in got} == sound and len(got) == len(sound)
    by = {r.line_id: r for r in got}
    assert by[6].id == "a" and by[6].score is None and by[6].start == 1
    assert rows(gff3_rows.rejected(df.where("false"), "line_id")) == []


def test_errors_name_rule_and_column(spark):
    lines = ['"s"\t\tgene\tx\t2\t1,5\t*\t7\tID=', 's\tx\tCDS\t9\t2\t.\t+\t.\tNote=a"b', "a\tb", "s\tx\tgene\t1\t2\t.\t+\t.\tID=a"]
    got = {r.line_id: r.errors for r in gff3_rows.with_errors(spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")).collect()}
    assert got == {
        0: ["quoting:seqid", "value:source", "value:start", "value:score", "value:strand", "value:phase", "value:attributes"],
        1: ["quoting:attributes", "value:end", "value:phase"], 2: ["columns"], 3: [],
    }


# 4
TEXTS = [None, "", "  ", "a", "a,b", " a | b/c;d\te ", "\"x y\",'p;q'", "\"open, b", "5'UTR,3'UTR", ",,a,,", '"",a', "it's", "\"a\"b", "a" * 50_000 + "," + "b", "x,x", "x,x", ",".join("v%d" % i for i in range(5000))]


def test_values(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "row_id bigint, parent string")
    got = packed.split_packed(df, ["row_id"], {"parent": "parent"}).select("row_id", "pos", "value")
    assert rows(got) == sorted(((i, p, v) for i, x in enumerate(TEXTS) for p, v in enumerate(plain.packed_values(x), 1)), key=str)
    two = packed.split_packed(df, ["row_id"], {"parent": "parent"}, least=2).select("row_id", "pos", "value")
    assert rows(two) == sorted(((i, p, v) for i, x in enumerate(TEXTS) if len(plain.packed_values(x)) > 1 for p, v in enumerate(plain.packed_values(x), 1)), key=str)
    assert {r.row_id: r.v for r in df.select("row_id", packed.values_of("parent").alias("v")).collect()} == {i: plain.packed_values(x) for i, x in enumerate(TEXTS)}
    flags = packed.split_packed(df.where("row_id = 7"), ["row_id"], {"parent": "parent"}).select("value", "flag")
    assert rows(flags) == [('"open', "unclosed"), ("b", None)]


def test_brackets(spark):
    texts = ["[a b],c", "[a,b", "a[b c]", "[]", "[[a]]", "['x y'] \"[q r]\"", "x,[y;z]|[u v]", "]a", "[a\"b c\"", None]
    want = [[("a b", None), ("c", None)], [("[a", "unclosed"), ("b", None)], [("a[b", None), ("c]", None)], [], [("[a", None), ("]", None)], [("'x y'", None), ("[q r]", None)],
            [("x", None), ("y;z", None), ("u v", None)], [("]a", None)], [('[a"b', "unclosed"), ('c"', None)], []]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, parent string")
    got = packed.split_packed(df, ["row_id"], {"parent": "parent"}, brackets=True).select("row_id", "pos", "value", "flag")
    assert rows(got) == sorted(((i, p, v, f) for i, w in enumerate(want) for p, (v, f) in enumerate(w, 1)), key=str)
    assert rows(packed.split_packed(df.where("row_id = 0"), ["row_id"], {"parent": "parent"}).select("value")) == sorted([("[a",), ("b]",), ("c",)])
    entries = spark.createDataFrame([(1, "Dbxref=[a;b c],d;x=[y"), (2, "db_xref \"[p]\"")], "row_id bigint, attributes string")
    got = packed.split_packed(entries, ["row_id"], {}, {"attributes": ("dbxref", ["dbxref", "db_xref"])}, brackets=True).select("row_id", "pos", "value")
    assert rows(got) == sorted([(1, 1, "a;b c"), (1, 2, "d"), (2, 1, "[p]")], key=str)


def test_entries(spark):
    texts = [
        "Name=a;Dbxref=X:1,Y:2;z=w", 'Name "a"; db_xref "X:1"; DB_XREF "Y:2";', 'dbxref=X:1;Note="Dbxref=N:1,N:2; more";DBxref=Y 2', 'Dbxref="A b;c",\'d;e\'',
        "Note=Dbxref", "Dbxref=", "Dbxref=only", "xDbxref=a,b", 'Note="it;Dbxref=1,2', " Dbxref = a , b ; c=d", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, attributes string")
    got = packed.split_packed(df, ["row_id"], {}, {"attributes": ("dbxref", ["Dbxref", "db_xref"])}).select("row_id", "pos", "value")
    want = {0: ["X:1", "Y:2"], 1: ["X:1", "Y:2"], 2: ["X:1", "Y", "2"], 3: ["A b;c", "d;e"], 6: ["only"], 8: ["1", "2"], 9: ["a", "b"]}
    assert rows(got) == sorted(((i, p, v) for i, vs in want.items() for p, v in enumerate(vs, 1)), key=str)


# 5
@pytest.mark.parametrize("scale", [30, 3_000, 40_000_000])
def test_periods(spark, scale):
    rnd = random.Random(scale)
    data = []
    for i in range(1500):
        s = rnd.randrange(1, scale)
        e = s + int(scale * rnd.random() ** 8) - (rnd.random() < 0.05) * 3
        data.append((rnd.choice(["f", "f", "g", None]), rnd.choice(["c"] * 5 + ["d", None]), rnd.choice([i, i, 7]), s if rnd.random() > 0.02 else None, e, "x"))
    data += data[:200]
    df = spark.createDataFrame(data, "file_id string, seqid string, locus_id bigint, start bigint, end bigint, kind string").repartition(6)
    for fold in (50, 200_000):
        got = periods.periods_and_gaps(df, ["file_id", "seqid"], "locus_id", "start", "end", fold_rows=fold)
        assert rows(got) == plain.periods([r[:5] for r in data])


def test_periods_touching_and_empty(spark):
    half = 1 << 20
    data = [("f", "c", 1, 1, 5), ("f", "c", 2, 6, 9), ("f", "c", 3, 9, 12), ("f", "c", 4, 14, 14), ("f", "c", 5, half - 5, half + 5), ("f", "c", 6, half + 5, 3 * half), ("f", "c", 7, 5 * half, 5 * half - 1)]
    df = spark.createDataFrame(data, "file_id string, seqid string, locus_id bigint, start bigint, end bigint")
    assert rows(periods.periods_and_gaps(df, ["file_id", "seqid"], "locus_id", "start", "end")) == plain.periods(data)
    assert rows(periods.periods_and_gaps(df.where("false"), ["file_id", "seqid"], "locus_id", "start", "end")) == []


# 6
def test_orphans(spark):
    t = lambda n: dt.datetime(2023, n, 1)
    refs = [(1, "f", "a,b", t(5)), (2, "f", "c", t(5)), (3, "g", "a", t(5)), (4, "f", "w, w ,late", t(5)), (5, "f", None, t(5)), (6, "f", " ,", t(5)), (7, "f", "nowhere", None), (8, None, "a", t(6)), (9, "f", "w", t(3))]
    tgts = [("f", "a", t(1), None, 1), ("f", "a", t(1), None, 1), ("f", "b", t(6), None, 1), ("f", "b", t(5), None, 1), ("f", "w", t(1), t(5), 1), ("f", "late", t(6), t(7), 1), ("f", None, t(1), None, 1)]
    r = spark.createDataFrame(refs, "row_id bigint, file_id string, parent string, loaded_at timestamp_ntz")
    g = spark.createDataFrame(tgts, "file_id string, id string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz, row_id int")
    got = orphans.orphans(
        [orphans.references(r, "t", 1, F.col("row_id"), packed.values_of("parent"), F.col("loaded_at"), F.col("file_id"))],
        [orphans.targets(g, 1, F.col("id"), F.col("loaded_at"), F.col("withdrawn_at"), F.col("file_id"))],
    )
    assert rows(got) == sorted(
        [("t", 2, "c", "2023-05", "missing"), ("t", 3, "a", "2023-05", "missing"), ("t", 4, "w", "2023-05", "deleted"), ("t", 4, "late", "2023-05", "late"), ("t", 7, "nowhere", None, "missing"), ("t", 8, "a", "2023-06", "missing")], key=str
    )
    assert rows(orphans.orphan_report(got))[0][:3] == ("t", "2023-05", "deleted")
