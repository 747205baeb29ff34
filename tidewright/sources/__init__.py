from .readers import (
    scan_auto,
    scan_csv,
    scan_excel,
    scan_json,
    scan_parquet,
    scan_records,
    table,
)
from .writers import append_dataset, sink_csv, sink_excel, sink_json, sink_parquet

__all__ = [
    "append_dataset",
    "scan_auto",
    "scan_csv",
    "scan_excel",
    "scan_json",
    "scan_parquet",
    "scan_records",
    "sink_csv",
    "sink_excel",
    "sink_json",
    "sink_parquet",
    "table",
]
