"""Readers: files, Kafka, JDBC and node logs."""
