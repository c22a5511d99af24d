"""Secrets of a set in messages."""

import json
import random
from urllib.parse import quote

from foliomill.operators.records import MASK
from foliomill.operators.redaction import header_secrets, masked, redact_set

KEY = 'sk/AbCd1234"x+y=='


def redacted(spark, texts, secrets, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, message string")
    return [r.message for r in redact_set(rows, spark.createDataFrame([(s,) for s in secrets], "secret string"), **options).orderBy("id").collect()]


def test_forms_of_a_key(spark):
    headers = spark.createDataFrame([("Authorization", f"Bearer {KEY}"), ("x-api-key", KEY), ("Content-Type", None), ("x", "Bearer ok")], "name string, value string")
    assert [r.secret for r in header_secrets(headers).collect()] == [KEY]
    texts = [f"got header Authorization: Bearer {KEY}", f"?k={quote(KEY, safe='')} json: {json.dumps(KEY)} {json.dumps(KEY).replace('/', chr(92) + '/')}", "model not found ok", "x" * 2000, None, ""]
    got = redacted(spark, texts, [KEY, "ok", None, KEY])
    assert got == [f"got header Authorization: Bearer {MASK}", f'?k={MASK} json: "{MASK}" "{MASK}"', "model not found ok", "x" * 300 + "…", None, ""]
    assert redacted(spark, texts[:1], []) == texts[:1]


def test_parts_of_a_set_give_the_same(spark):
    r = random.Random(6)
    secrets = ["".join(r.choice("ab1") for _ in range(r.randint(7, 12))) for _ in range(60)]
    texts = ["".join(r.choice(["a", "b", "1", " ", r.choice(secrets)]) for _ in range(30)) for _ in range(40)]
    long = {s for s in secrets if len(s) >= 8}
    want = []
    for t in texts:
        places = [x for s in long for i in range(len(t)) if t.startswith(s, i) for x in (i, i + len(s))]
        want.append(masked(t, places)[:300] + "…" * (len(masked(t, places)) > 300))
    assert redacted(spark, texts, secrets) == redacted(spark, texts, secrets, part=25) == want
    assert masked("abcdef", [1, 3, 2, 4, 4, 5]) == f"a{MASK}{MASK}f"


def test_a_large_set_is_one_step(spark):
    """every 20,000 secrets took a worker of their own beside the others, with an automaton."""
    secrets = [f"key-{i:06d}/é\"" for i in range(50_000)]
    rows = spark.createDataFrame([(i, f"a {quote(secrets[i * 900], safe='')} {secrets[i * 900 + 1]}é{secrets[i]}") for i in range(50)], "id int, message string")
    found = redact_set(rows, spark.createDataFrame([(s,) for s in secrets], "secret string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.message for r in found.collect()} == {f"a {MASK} {MASK}é{MASK}"}
