"""Small node tables with the stored schema."""

from __future__ import annotations

import datetime as dt

SCHEMA = (
    "delivery_no long, batch_no long, delivered_at timestamp_ntz, partition_name string, pk string, text string, source string, title string, parent_id string, child_ids array<string>, node_type string, level long, token_count long, "
    "left_sibling string, right_sibling string, from_split boolean, merged boolean, nav_next_step string, nav_see_also string, entry_urls array<string>, related_links array<struct<text:string,url:string,pk:string,type:string>>, summary string, "
    "timestamp long, vector array<float>, summary_vector array<float>, sparse_vector map<int,double>, title_sparse map<int,double>"
)
NAMES = [x.split()[0] for x in SCHEMA.replace("text:string,url:string,pk:string,type:string", "").replace("map<int,double>", "map").split(", ")]


def uid(n: int) -> str:
    return f"00000000-0000-5000-8000-{n:012d}"


def table(spark, rows: list[dict], extra: str = ""):
    """A node table; missing fields are null, delivery_no counts up, delivered_at is one minute a row."""
    full = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(NAMES)
        base.update(delivery_no=i, batch_no=i // 3, delivered_at=dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i), partition_name="static_knowledge")
        base.update(r)
        full.append(base)
    names = NAMES + [x.split()[0] for x in extra.split(", ") if x]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], SCHEMA + (", " + extra if extra else ""))
