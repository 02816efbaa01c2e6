"""Event analytics on PySpark: medallion streams, marts, traffic KPIs, contracts."""
