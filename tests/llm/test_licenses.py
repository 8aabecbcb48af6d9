import random

from pyspark.sql import functions as F

from stringloom.llm import licenses


def brute(text, templates, threshold=0.8):
    """All stretches of words and all templates: of each template and first word the best end, then the best of what overlaps."""
    words = licenses.words_of(text.encode())
    found = []
    for name, t in templates:
        grams = licenses.bigrams(licenses.words_of(t.encode()))
        for i in range(len(words)):
            ends = [(-licenses.dice(licenses.bigrams(words[i:j]), grams), j - i) for j in range(i + 2, min(len(words), i + 2 * grams.total() + 3) + 1)]
            good = min((e for e in ends if -e[0] >= threshold), default=None)
            if good:
                found.append((good[0], i, good[1], name))
    kept = []
    for score, i, n, name in sorted(found):
        if all(i + n <= a or i >= a + k for a, k, _, _ in kept):
            kept.append((i, n, name, -score))
    return [(name, score, i, n) for i, n, name, score in sorted(kept)]


def test_matches_equal_brute_force():
    rng = random.Random(3)
    templates = [t for t in licenses.default_templates() if len(t[1].split()) < 14] + [("X", "a a a b a a"), ("Y", "a b"), ("X", "a b a b a b")]
    scanner = licenses.Scanner(templates)
    some = 0
    for n in range(150):
        words = [rng.choice(["a", "b", "c"] if n % 3 else "the of any software license is provided as with under".split()) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(templates)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        text = rng.choice([" ", "\n", ", "]).join(words)
        found = scanner.scan(text.encode())
        assert found == brute(text, templates)
        some += len(found)
    assert some > 100


def test_notices_inside_sentences_and_lines():
    scanner = licenses.Scanner(licenses.default_templates())
    text = "Note that this code is licensed under the MIT License and may be copied by anyone who likes it, see above"
    assert [m[0] for m in scanner.scan(text.encode())] == ["MIT"]
    line = "words before " * 40 + licenses._MIT.replace("\n", " ") + " words after" * 40
    (found,) = scanner.scan(line.encode())
    assert found == ("MIT", 1.0, 80, len(licenses.words_of(licenses._MIT.encode())))
    (found,) = scanner.scan(licenses._LGPL.format(kind="Lesser", version="2.1").encode())
    assert found[:2] == ("LGPL-2.1", 1.0)


def test_dense_texts_and_ties():
    scanner = licenses.Scanner(licenses.default_templates())
    many = scanner.scan(b"Released under the MIT License.\n" * 3000)
    assert len(many) == 3000 and {m[:2] for m in many} == {("MIT", 1.0)}
    tied = licenses.Scanner([("B", "one two three"), ("A", "one two three")]).scan(b"zero one two three four")
    assert tied == [("A", 1.0, 1, 3)]


def test_long_licence_in_a_file():
    text = "// Copyright 2020\n" + licenses._MIT.replace("merge", "fuse") + "\n\nint main() { return 0; }\n"
    (found,) = licenses.Scanner(licenses.default_templates()).scan(text.encode())
    assert found[0] == "MIT" and 0.95 < found[1] < 1


def test_report(spark):
    rows = [(1, None), (2, ""), (3, "Free text.\nReleased under the MIT License."), (3, "Free text.\nReleased under the MIT License."), (4, "x " * 30000 + "\nLicensed under CC BY-NC 4.0."), (5, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("matches", F.lit(1)).withColumn("license", F.lit(2))
    got = sorted((r["doc_id"], r["n_matches"], r["licenses"], r["best_license"], r["best_dice"]) for r in licenses.license_report(df).collect())
    assert got == [(1, 0, "", None, None), (2, 0, "", None, None), (3, 1, "MIT", "MIT", 1.0), (3, 1, "MIT", "MIT", 1.0), (4, 1, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1.0), (5, 0, "", None, None)]
    assert licenses.license_report(df.limit(0)).count() == 0
