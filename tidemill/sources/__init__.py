"""Sources and sinks: tables, JSON records, idempotent and merging writes, audit and outbox."""
