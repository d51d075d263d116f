"""Secret scans of very long candidates and of very many matches in one text."""

import hashlib
import random
import re
import string

from test_ops import added_brute, docs
from tiepoint.llm import secrets

GIVING_BACK = "^[A-Za-z]?(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[_=+/-]|(?<![A-Za-z])[A-Za-z](?![A-Za-z]))*[A-Za-z]?$"


def test_the_possessive_rule_allows_the_same_spans():
    rnd = random.Random(1)
    for _ in range(60_000):
        span = "".join(rnd.choice("aabABc/") for _ in range(rnd.randint(0, 12)))
        assert bool(re.search(GIVING_BACK, span)) == bool(re.search(secrets.ALLOWED[1], span)), span


def test_long_spans_and_many_matches(spark):
    """A megabyte in one candidate and a hundred thousand matches in one text take seconds, and lose nothing."""
    rnd = random.Random(3)
    word = lambda letters, low, high: "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    alphanumeric = string.ascii_letters + string.digits
    words = "/".join(word(string.ascii_lowercase, 2, 9) for _ in range(160_000))
    mixed = "/".join(word(alphanumeric, 30, 30) if k % 3 else "just/some/words/" + "a" * 60 for k in range(3_000))
    assigns = " ".join(f"é token={word(alphanumeric, 3, 12)}" for _ in range(100_000))
    hexes = " ".join(f"{k:032x}" for k in range(20_000))
    texts = [words, mixed, assigns, hexes]
    rows = docs(spark, list(enumerate(texts))).repartition(4, "doc_id")
    got = {r.doc_id: r for r in secrets.scan(rows).selectExpr("doc_id", "base", "added", "size(base) n").collect()}
    assert not got[0].n and not got[0].added and len(words) > 900_000
    assert ",".join(f"entropy:{a}:{b}" for a, _, b in got[1].added) == added_brute(mixed)
    want = [(m.start(), 0, m.end()) for m in re.finditer("token=([A-Za-z0-9]+)", assigns) if len(m[1]) >= 8]
    assert [tuple(x) for x in got[2].base] == want and len(want) > 40_000
    assert [tuple(x) for x in got[3].base] == [(33 * k, 2, 33 * k + 32) for k in range(20_000)]


def test_blocks_of_a_candidate_join(spark):
    """Spans that cross the blocks in which a long candidate is passed are the same as judged one by one."""
    rnd = random.Random(4)
    pick = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    texts = ["".join(pick(rnd.randint(5, 90), rnd.choice(["01", "ab", string.ascii_letters + string.digits, "0123456789abcdef"])) for _ in range(rnd.randint(1, 12))) for _ in range(80)]
    got = {r.doc_id: r.t for r in secrets.scan(docs(spark, list(enumerate(texts)))).withColumn("t", secrets.spans_text(secrets.F.col("added"))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == added_brute(t), (t, hashlib.md5(t.encode()).hexdigest())
