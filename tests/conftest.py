from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docquarry.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def documents(spark):
    """Python objects in the wire shape -> a canonical corpus."""
    from docquarry.sources.documents import documents_from_text

    def build(*docs):
        text = spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")
        return documents_from_text(text)

    return build


def wire(class_name="base", blocks=None, version="1.0.0", parents=(("base", "1.0.0"),), depends_on=(), **base):
    doc = {
        "document_class": {
            "class_name": class_name,
            "class_version": version,
            "superclasses": [] if class_name == "base" else [{"class_name": n, "class_version": v} for n, v in parents],
        },
        "depends_on": list(depends_on),
        "base": {
            "id": "4126919195e6b5af_40d651024919a2e4",
            "session_id": "4126919195e8839b_40c6d9f78d173ae7",
            "name": "my_test_document",
            "datestamp": "2024-06-01T12:00:00.000Z",
            **base,
        },
    }
    doc.update(blocks or {})
    return doc
