import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def people_frame(spark, rows):
    """rows: dicts with at least person_id; everything else has a default."""
    from tieweave.schema import PERSON

    full = []
    for r in rows:
        base = {"network_id": "n", "name": f"p{r['person_id']}", "bio": None, "notes": None, "is_me": False, "is_wishlist": False,
                "tags": [], "skills": [], "companies": [], "cities": [], "needs": []}
        full.append(tuple({**base, **r}[f] for f in PERSON.fieldNames()))
    return spark.createDataFrame(full, PERSON)


def edge_frame(spark, rows):
    """rows: (source, target, strength[, context]) in storage order."""
    from tieweave.schema import EDGE

    full = [("n", i, r[0], r[1], r[2], r[3] if len(r) > 3 else None, "yearly", "manual", None) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, EDGE)
