"""Where references to collections stand, against Python's own matches."""

import random
import re

from schemasight.operators import references as N
from schemasight.registry import COLLECTIONS

PIECES = [
    'db.getCollection("carts")', '@Document(collection = "users")', "\n", " é\U0001f600 ", 'mongoTemplate.find(q,\n  "late")', "mongoTemplate.find(q, Order.class)", "db['x']", 'getCollection("é")', "db.orders.find(", "db.größe.count",
    "getCollection(AppConstants.F1)", 'COLLECTION_NAME = "k"', "text ", ")", '"', "static final String MY_COLLECTION = \"m\"", 'getCollection("a")getCollection("b")',
]


def test_positions(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 30))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    found = N.references(df)
    want = {(f, m.start(), k, p.kind, m[1]) for f, t in enumerate(texts) for k, p in enumerate(COLLECTIONS) for m in re.finditer(p.regex, t or "")}
    got = [tuple(x) for x in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
