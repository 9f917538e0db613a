import random

from helpers import documents
from tieweave.llm import line_join as lj


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _texts(spark, texts):
    return [r.text for r in sorted(lj.without_alike_lines(documents(spark, texts)).collect())]


def test_every_pair_by_edit_similarity_alone(spark):
    rng = random.Random(3)
    lines = []
    for s in range(60):
        # Words with digits, and few of them in some lines, so that word pairs repeat.
        base = [f"w{rng.randrange(4000 if s % 4 else 3)}" for _ in range(5 + 7 * (s % 9))]
        lines.append(base)
        for _ in range(3):
            new = list(base)
            for _ in range(rng.randrange(len(base) // 4 + 2)):
                at, kind = rng.randrange(len(new) or 1), rng.randrange(3)
                new[at : at + (kind > 0)] = [f"x{rng.randrange(10**6)}"] if kind < 2 else []
            lines.append(new)
    rng.shuffle(lines)
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(lines)):
        for b in range(a):
            n = max(len(lines[a]), len(lines[b]))
            if lines[a] == lines[b] or min(len(lines[a]), len(lines[b])) >= lj.MIN_WORDS and 5 * _edits(lines[a], lines[b]) <= n:
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    want = [" ".join(x) if find(i) == i else "" for i, x in enumerate(lines)]
    assert 20 < sum(not w for w in want) < len(lines)
    assert _texts(spark, [" ".join(x) for x in lines]) == want


def test_lines_that_differ_in_digits_or_marks_only(spark):
    texts = [
        "On 3 May the price in Paris was 12 euro", "On 17 May the price in Paris was 940 dollar", "3 12 4 55", "3 12 4 56", "कि का", "कु का",
        # Nine of ten words agree: edit similarity decides.
        "on 3 may the price in that town was 12", "on 4 may the price in that town was 12",
    ]
    assert _texts(spark, texts) == [*texts[:7], ""]


def test_short_lines_lines_of_signs_and_scripts_without_blanks(spark):
    long = "今日天气很好我们一起去公园散步"
    texts = ["Read more", "read more!", "-----", " -----", "=====", "12,5", "12.5", long, long.replace("公", "花"), "完全不同的一行文字没有重复", "\n \n", "read less"]
    assert _texts(spark, texts) == ["Read more", "", "-----", "", "=====", "12,5", "", long, "", texts[9], "\n \n", "read less"]
