import random
import re

from tilewright.operators.rejects import BLAST, PAF, parse_hit_lines, rejects, valid_records

SCHEMA = "line_id long, raw_line string, line_format string, reason string"


def fields_of(line):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, value = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + line[j], j + 1
            if j + 1 < len(line) and line[j + 1] != "\t":
                return None
            out.append(value)
            i = j + 1
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            out.append(line[i:j])
            i = j
        if i >= len(line):
            return out
        i += 1


def brute(line, form):
    if line is None:
        return None
    line = line[:-1] if line.endswith("\r") else line
    if not line or line[0] == "#":
        return None
    f = fields_of(line)
    if f is None:
        return "broken_quote"
    spec = PAF if form == "paf" else BLAST
    if (form == "paf" and (len(f) < 12 or any(not re.match(r"[A-Za-z][A-Za-z0-9]:[AifZHB]:", x, re.A) for x in f[12:]))) or (form == "blast" and len(f) != 7):
        return "column_count"
    v = {}
    for (name, kind), x in zip(spec, f):
        if kind == "N" and not x or kind == "S" and x not in ("+", "-"):
            return "bad_value"
        if kind == "I":
            if not re.fullmatch("[0-9]+", x, re.A) or int(x) > 4294967295:
                return "bad_value"
            v[name] = int(x)
    ok = v["query_start"] <= v["query_end"] <= v["query_length"]
    ok &= (v["target_start"] <= v["target_end"] <= v["target_length"] and v["matching_bases"] <= v["block_length"]) if form == "paf" else (v["query_start"] >= 1 and v["matching_bases"] <= v["alignment_length"])
    return "" if ok else "bad_value"


def outcome(spark, lines):
    df = spark.createDataFrame([(i, line, form, "extra") for i, (line, form) in enumerate(lines)], SCHEMA)
    got = {r.line_id: r.reason or "" for r in parse_hit_lines(df).collect()}
    return [got.get(i) for i in range(len(lines))]


def test_random_lines_against_a_plain_parser(spark):
    rng = random.Random(11)
    paf = ["q1", "120", "0", "120", "+", "t", "1000", "5", "125", "118", "120", "60", "NM:i:1", 'cg:Z:"x']
    blast = ["q", "t", "120", "1", "100", "90", "100"]
    odd = ['"', '""', '"a"', '"a""b"', '"a\tb"', 'a"b', '"a"b', "", " ", "01", "00000000000000007", "4294967295", "4294967296", "99999999999", "-1", "+1", "1.5", "é", '"12"', '"+"', "#", "\r", "٣", '"a" ', '"""', '""""']
    lines = []
    for _ in range(3000):
        form = rng.choice(["paf", "blast"])
        f = list(paf[: rng.choice([12, 12, 13, 14, 11])] if form == "paf" else blast)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            f[rng.randrange(len(f))] = rng.choice(odd)
        if rng.random() < 0.1:
            f.insert(rng.randrange(len(f)), rng.choice(odd))
        lines.append(("\t".join(f) + rng.choice(["", "", "", "\r", "\t", "\r\r", '"']), form))
    lines += [(None, "paf"), ("", "paf"), ("\r", "blast"), ("#x", "paf"), ("# \"", "blast"), ('"', "paf"), ("\t" * 50, "paf"), ("x" * 200_000, "blast"), ('"' + "\t" * 30, "paf")]
    rng.shuffle(lines)  # runs of quotes at line ends meet those of the next line
    got = outcome(spark, lines)
    want = [brute(line, form) for line, form in lines]
    assert [x for x in zip(lines, got, want) if x[1] != x[2]][:3] == []
    assert {"", None, "broken_quote", "column_count", "bad_value"} <= set(want)


def test_typed_values(spark):
    df = spark.createDataFrame([(1, '"q ""a"""\t00120\t0\t"120"\t"-"\tt\t1000\t5\t125\t118\t120\t60\tNM:i:1\r', "paf", ""), (2, "q\tt\t120\t1\t100\t90\t4294967295", "blast", ""), (3, "x", None, ""), (4, "x", "gff", "")], SCHEMA)
    parsed = parse_hit_lines(df)
    assert tuple(valid_records(parsed, "paf").collect()[0]) == (1, 'q "a"', 120, 0, 120, "-", "t", 1000, 5, 125, 118, 120, 60)
    assert tuple(valid_records(parsed, "blast").collect()[0]) == (2, "q", "t", 120, 1, 100, 90, 4294967295)
    assert sorted(tuple(r) for r in rejects(parsed).collect()) == [(3, "unknown_format"), (4, "unknown_format")]


def test_empty_and_repeated(spark):
    assert parse_hit_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "bad", "paf", "")] * 3, SCHEMA)
    assert [tuple(r) for r in rejects(parse_hit_lines(df)).collect()] == [(1, "column_count")] * 3


def test_quotes_outside_quoted_fields_stay(spark):
    df = spark.createDataFrame([(1, 'q""x\tt"\t120\t1\t100\t90\t100', "blast", ""), (2, '"q""x"\t"a\t""b"\t120\t1\t100\t90\t100', "blast", ""), (3, '"q""""x"\ta""\t120\t1\t100\t90\t100', "blast", "")], SCHEMA).coalesce(1)
    got = {r.line_id: (r.query_name, r.target_name) for r in valid_records(parse_hit_lines(df), "blast").collect()}
    assert got == {1: ('q""x', 't"'), 2: ('q"x', 'a\t"b'), 3: ('q""x', 'a""')}
