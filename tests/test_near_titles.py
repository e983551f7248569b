import random

from quarry.operators.resolve import near_titles


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def digits(k):
    return "".join(c if c.isdigit() else " " for c in k).split()


def brute(rows):
    out = set()
    for i, v, y, a in rows:
        for j, w, z, b in rows:
            if i < j and (v, y) == (w, z) and digits(a) == digits(b):
                longest, d = max(len(a), len(b)), distance(a, b)
                if a == b or 1 - d / longest >= 0.9:
                    out.add((i, j, d, "exact" if a == b else "similar"))
    return out


def test_near_titles_of_any_length(spark):
    rng = random.Random(4)
    words = ["deep", "nets", "trust", "models", "of", "the", "learning", "größe", "12", "7", "as"]
    keys = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 3, 4, 5, 6, 8, 12, 18, 25, 50, 60, 75, 110)] + ["as " * 120 + "as"]

    def typed(k, edits):
        letters = list(k)
        for _ in range(edits):
            at = rng.choice([0, rng.randrange(len(letters))])  # the first letter too
            rng.choice([lambda: letters.insert(at, "x"), lambda: letters.pop(at), lambda: letters.__setitem__(at, "q")])()
        return "".join(letters)

    texts = [typed(k, e) for k in keys for e in (0, 0, 0, 1, len(k) // 20, len(k) // 10, len(k) // 10 + 1)]
    rows = [(f"p{i:04}", "AB"[i % 2], 2020, k) for i, k in enumerate(texts)] + [("z1", "A", 2021, keys[-1])]
    found = near_titles(spark.createDataFrame(rows, "id string, venue string, year int, k string")).collect()
    got = [(r["id_a"], r["id_b"], r["distance"], r["verdict"]) for r in found]
    expected = brute(rows)
    assert len(got) == len(set(got)) and set(got) == expected
    by = {i: k for i, _, _, k in rows}
    assert any(v == "similar" and by[i].split()[0] != by[j].split()[0] for i, j, _, v in expected)
    assert any(v == "exact" and len(by[i]) >= 255 for i, _, _, v in expected)
