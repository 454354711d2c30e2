"""Writers: idempotent batch tables, JDBC, exports and forecast replacement."""
