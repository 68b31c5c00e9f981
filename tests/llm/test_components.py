import random

from tilewright.llm.components import connected_groups

SCHEMA = "a string, b string, v string, rep string"


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, *_ in pairs:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {(find(x), x) for x in parent}


def check(spark, pairs, **limits):
    rows = [(*p, "x", "y") for p in pairs]
    got = [tuple(r) for r in connected_groups(spark.createDataFrame(rows, SCHEMA), "a", "b", **limits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pairs)


def test_chain_star_cliques_and_noise(spark):
    rng = random.Random(1)
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(400)]
    star = [("hub", f"s{i}") for i in range(300)]
    clique = [(f"q{i}", f"q{j}") for i in range(12) for j in range(i)]
    noise = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(150)]
    pairs = chain + star + clique + noise + [(b, a) for a, b in noise] + [("hub", "s1")] * 200 + [(None, "x"), ("x", None), ("x", "x"), ("é", "z"), ("Z", "z")]
    rng.shuffle(pairs)
    check(spark, pairs, cell_pairs=100)


def test_hub_with_most_pairs_in_few_blocks(spark):
    check(spark, [("hub", f"s{i:04d}") for i in range(900)] + [("s0001", "t"), ("u", "w")], cell_pairs=40, most_blocks=3)


def test_no_links(spark):
    check(spark, [])
    check(spark, [("a", "a"), (None, None)])
    check(spark, [("b", "a")])


def test_heavy_ids_are_cut_in_every_join(spark):
    pairs = [("hub", f"s{i:04d}") for i in range(900)] + [(f"s{i:04d}", f"t{i:04d}") for i in range(900)] + [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(200)]
    check(spark, pairs, cell_pairs=60, per_slice=40)
