"""Backup-ledger analytics and content-addressed object processing on Spark."""
