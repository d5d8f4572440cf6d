"""Small builders shared by the tests."""

from __future__ import annotations

from datetime import datetime

from linkloom.schema import BOOKMARK_COLUMNS, BOOKMARK_SCHEMA

T0 = "2024-06-01 12:00:00"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def bookmark(**given):
    row = {
        "id": "",
        "source": "github",
        "url": "https://github.com/test/repo1",
        "title": "t",
        "summary": "",
        "keywords": "",
        "notes": "",
        "raw_content": "",
        "created_at": at("2024-01-01"),
        "updated_at": at("2024-01-01"),
        "scraped_at": None,
        "scrape_status": "pending",
        "hidden": False,
    }
    row.update(given)
    if not row["id"]:
        import hashlib

        row["id"] = hashlib.sha256(row["url"].encode()).hexdigest()[:16]
    return tuple(row[c] for c in BOOKMARK_COLUMNS)


def table(spark, *rows):
    return spark.createDataFrame([bookmark(**r) for r in rows], BOOKMARK_SCHEMA)


def by(df, key="url"):
    return {row[key]: row.asDict(recursive=True) for row in df.collect()}
