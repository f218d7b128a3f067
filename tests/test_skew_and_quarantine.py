import random
import re

from stipple.operators import quarantine, skew
from stipple.operators.quarantine import BARCODE, MOLECULE


def test_eager_aggregation_equals_the_join(spark):
    rng = random.Random(1)
    genes = ["hot"] * 300 + ["a", "b", "c", None, ""] * 20
    left = [(i, rng.choice(genes), rng.choice([None, -3, 0, 5, 2147483647])) for i in range(2000)]
    right = [(n, i) for i, n in enumerate(["hot", "hot", "a", None, "z", ""])]
    l, r = spark.createDataFrame(left, "key long, gene string, count int"), spark.createDataFrame(right, "name string, count long")
    got = {x.g: tuple(x)[1:] for x in skew.eager_aggregate_join(l, r, "gene", "name", "count", key_as="g").collect()}
    for g in {x[1] for x in left}:
        own = [x[2] for x in left if x[1] == g]
        n = sum(1 for name, _ in right if name is not None and name == g)
        known = [v for v in own if v is not None]
        assert got[g] == (len(own), sum(known) if known else None, n, len(own) * n, sum(known) * n if known else None)
    inner = {x.g for x in skew.eager_aggregate_join(l, r, "gene", "name", "count", how="inner", key_as="g").collect()}
    assert inner == {"hot", "a", ""}


def test_hot_keys(spark):
    df = spark.createDataFrame([("h", 1)] * 50 + [("m", 1)] * 25 + [(None, 1)] * 24 + [("r", 1)], "gene string, count int")
    per = skew.eager_aggregate_join(df, spark.createDataFrame([], "name string"), "gene", "name", "count")
    assert sorted(r.key for r in skew.hot_keys(per, 0.25).collect()) == ["h", "m"]
    assert [r.key for r in skew.hot_keys(per, 0.26).collect()] == ["h"]
    none = skew.eager_aggregate_join(df.limit(0), spark.createDataFrame([], "name string"), "gene", "name", "count")
    assert skew.hot_keys(none, 0.1).collect() == []


def plain_reason(kind, line):
    """The rules, one character at a time."""
    s = line or ""
    s = s[:-1] if s.endswith("\r") else s
    s = s[1:] if s.startswith("﻿") else s
    fields, at = [], 0
    while True:
        if at < len(s) and s[at] == '"':
            at, text = at + 1, ""
            while True:
                if at >= len(s):
                    return "quoting", None
                if s[at] == '"':
                    if s[at + 1 : at + 2] == '"':
                        text, at = text + '"', at + 2
                        continue
                    at += 1
                    break
                text, at = text + s[at], at + 1
            if at < len(s) and s[at] != "\t":
                return "quoting", None
        else:
            end = s.find("\t", at)
            text = s[at:] if end < 0 else s[at:end]
            if '"' in text:
                return "quoting", None
            at = len(s) if end < 0 else end
        fields.append(text)
        if at >= len(s):
            break
        at += 1
    layout = {"mol": MOLECULE, "sbcd": BARCODE}.get(kind)
    if layout is None or len(fields) != len(layout.fields):
        return "columns", None
    for v, how in zip(fields, layout.fields.values()):
        if how == "decimal":
            ok = bool(re.fullmatch(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", v)) and abs(float(v)) < float("inf")
        elif how == "text":
            ok = v != ""
        else:
            ok = bool(re.fullmatch("[0-9]+", v)) and int(v) <= (2**31 - 1 if how == "int" else 2**63 - 1)
        if not ok:
            return "value", None
    return None, fields


LINES = [
    ("mol", "1.5\t-2\tg\tid\t3"), ("mol", "﻿1\t2\tg\tid\t3\r"), ("mol", '1\t2\t"a ""b""\tc"\tid\t3'), ("mol", '1\t2\t"open\tid\t3'), ("mol", '1\t2\ta"b\tid\t3'),
    ("mol", '1\t2\t"x"y\tid\t3'), ("mol", "1\t2\tg\tid"), ("mol", "1\t2\tg\tid\t3\t"), ("mol", "1\t2\t\tid\t3"), ("mol", '1\t2\t""\tid\t3'), ("mol", "1e400\t2\tg\tid\t3"),
    ("mol", "1e5\t2E-3\tg\tid\t2147483647"), ("mol", "1\t2\tg\tid\t2147483648"), ("mol", "1\t2\tg\tid\t0002147483647"), ("mol", "+1\t2\tg\tid\t1"), ("mol", ".5\t2\tg\tid\t1"),
    ("mol", "5.\t2\tg\tid\t1"), ("mol", "1\t2\tg\tid\t-1"), ("mol", "1\t2\tg\tid\t١"), ("mol", "1\t2\tg\tid\t 1"), ("mol", ""), ("mol", None), ("mol", "\t\t\t\t"), ("mol", "nan\t2\tg\tid\t1"),
    ("sbcd", "ACG\t1\t1101\t9223372036854775807\t0\t0"), ("sbcd", "ACG\t1\t1101\t9223372036854775808\t0\t0"), ("sbcd", '"ACG"\t"1"\t2\t3\t4\t5'), ("sbcd", 'ACG\t1\t2\t3\t4\t"'),
    ("sbcd", "ACG\t1\t2\t3\t4\t5\n"), ("other", "1\t2"), (None, "1\t2\tg\tid\t3"), ("mol", '"'), ("mol", '""'), ("mol", '"a"\t'), ("mol", "1\t2\tg\tid\t3\r\r"),
]


def test_every_rule(spark):
    rng = random.Random(4)
    fuzz = [(rng.choice(["mol", "sbcd"]), "".join(rng.choice('"\t1a.\r') for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    lines = [(i, k, v, "kept") for i, (k, v) in enumerate(LINES + fuzz)]
    df = spark.createDataFrame(lines, "line_id long, kind string, line string, reason string")
    parsed = quarantine.parse_lines(df, {"mol": MOLECULE, "sbcd": BARCODE})
    got = {r.line_id: (r.errors[0].reason if r.errors else None, list(r.fields) if r.fields is not None and not r.errors else None) for r in parsed.collect()}
    assert got == {i: plain_reason(k, v) for i, k, v, _ in lines}
    bad = quarantine.rejected(parsed)
    assert bad.count() + sum(quarantine.accepted(parsed, k, s).count() for k, s in (("mol", MOLECULE), ("sbcd", BARCODE))) == len(lines)


def test_typed_rows_and_long_fields(spark):
    long = '"' + 'ab""' * 60_000 + '"'
    df = spark.createDataFrame([(1, "mol", f"1\t2\t{long}\tid\t7"), (2, "mol", "x" * 300_000)], "line_id long, kind string, line string")
    parsed = quarantine.parse_lines(df, {"mol": MOLECULE})
    row = quarantine.accepted(parsed, "mol", MOLECULE).first()
    assert (row.x, row.y, row.gene_id, row["count"], len(row.gene)) == (1.0, 2.0, "id", 7, 180_000)
    assert [(r.line_id, r.reason) for r in quarantine.rejected(parsed).collect()] == [(2, "columns")]
    assert quarantine.rejected(quarantine.parse_lines(df.limit(0), {"mol": MOLECULE})).collect() == []


def test_one_error_a_broken_rule(spark):
    lines = [(1, "mol", "a\t\t\tENS1\tx"), (2, "sbcd", "AC\t1\t99999999999\t3\t-4"), (3, "mol", '1\t2\t"g\tENS1\t3'), (4, None, "a"), (5, "mol", "1\t2\tg\ti\t3")]
    parsed = quarantine.parse_lines(spark.createDataFrame(lines, "line_id int, kind string, line string"), {"mol": quarantine.MOLECULE, "sbcd": quarantine.BARCODE})
    got = {r.line_id: [tuple(e) for e in r.errors] for r in parsed.collect()}
    assert got == {
        1: [("value", "x", "a"), ("value", "y", ""), ("value", "gene", ""), ("value", "count", "x")],
        2: [("columns", None, "5"), ("value", "tile", "99999999999"), ("value", "py", "-4")],
        3: [("quoting", None, None)], 4: [("columns", None, "1")], 5: [],
    }
    assert quarantine.broken_rules(parsed).filter("line_id = 1").count() == 4
