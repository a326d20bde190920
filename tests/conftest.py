from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from hostvane.schemas import FEATURES
from hostvane.session import local_session, scratch_root


@pytest.fixture(scope="session")
def spark():
    shared = "file://" + tempfile.mkdtemp(prefix="hostvane-tests-")
    session = local_session("tests", 4, 4, spark__checkpoint__dir=shared)
    session.sparkContext.setLogLevel("ERROR")
    assert scratch_root(session) == shared
    yield session
    session.stop()


START = dt.datetime(2026, 2, 1)
COLUMNS = (
    "record_id long, ingestion_time timestamp_ntz, metric_timestamp timestamp_ntz, host_id string, project_id string, "
    "region string, " + ", ".join(f"{f} double" for f in FEATURES) + ", labels string, run_id string, "
    "is_anomaly boolean, anomaly_type string"
)


def reading(record_id, seconds=None, host="h1", run="r1", cpu=10.0, mem=10.0, disk=10.0, rx=10.0, tx=10.0, **more):
    at = START + dt.timedelta(seconds=record_id if seconds is None else seconds)
    row = {
        "record_id": record_id,
        "ingestion_time": at + dt.timedelta(seconds=2),
        "metric_timestamp": at,
        "host_id": host,
        "project_id": "p1",
        "region": "us",
        "cpu_usage": float(cpu),
        "memory_usage": float(mem),
        "disk_utilization": float(disk),
        "network_rx_rate": float(rx),
        "network_tx_rate": float(tx),
        "labels": "{}",
        "run_id": run,
        "is_anomaly": False,
        "anomaly_type": None,
    }
    return {**row, **more}


@pytest.fixture(scope="session")
def telemetry(spark):
    def build(rows):
        names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)

    return build


def by_record(df, *columns):
    return {r["record_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def counted(df):
    return df.agg(F.count(F.lit(1))).first()[0]
