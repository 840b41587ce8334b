from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyferry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false", "spark.sql.maxMetadataStringLength": "2000",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def bills(spark):
    """Five bills of one tenant and one of another, with vendors and projects; own invented rows."""
    vendors = spark.createDataFrame(
        [("v1", "Lindqvist Papier", "desk@lindqvist.test"), ("v2", "Blue Harbour Data", "ar@harbour.test"), ("v3", "Ortega & Sons", None)],
        "id string, name string, email_address string",
    )
    projects = spark.createDataFrame(
        [("p1", "KX-1", "Archive"), ("p2", "KX-2", "Basement"), ("p3", "KX-3", "Canteen")], "id string, code string, name string"
    )
    rows = [
        ("doc-1", "T1", 80.00, datetime(2024, 1, 9, 8), "open", "Paper and ink for the copier", "v1", "p1"),
        ("doc-2", "T1", 1200.75, datetime(2024, 1, 11, 8), "settled", "Annual database licence", "v2", "p2"),
        ("doc-3", "T1", 4100.00, datetime(2024, 1, 12, 8), "open", "Audit of the ledgers", "v1", "p1"),
        ("doc-4", "T1", 310.40, datetime(2024, 1, 8, 8), "late", "Copier repair", "v3", "p3"),
        ("doc-5", "T1", 56000000.50, datetime(2024, 1, 13, 8), "settled", None, None, None),
        ("doc-6", "T2", 77.00, datetime(2024, 1, 10, 8), "open", "Other tenant", "v2", "p2"),
    ]
    table = spark.createDataFrame(
        rows,
        "id string, client_id string, amount double, date timestamp_ntz, status string, description string, "
        "vendor_id string, project_id string",
    ).selectExpr("* EXCEPT (amount)", "CAST(amount AS DECIMAL(15,2)) AS amount")
    return {"bill": table, "vendor": vendors, "project": projects}
