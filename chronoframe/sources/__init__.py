"""File and table sources."""

from chronoframe.sources.files import (
    rename_map, scan_csv, scan_csv_in_zip, scan_csv_preamble, scan_csv_tagrow, scan_geojson, scan_json_array,
    scan_json_pages, scan_json_variant, scan_table,
)
from chronoframe.sources.footers import footer_aggregates, footer_query, footer_stats
from chronoframe.sources.records import csv_records

__all__ = ["csv_records", "footer_aggregates", "footer_query", "footer_stats",
           "rename_map", "scan_csv", "scan_csv_in_zip", "scan_csv_preamble", "scan_csv_tagrow", "scan_geojson",
           "scan_json_array", "scan_json_pages", "scan_json_variant", "scan_table"]
