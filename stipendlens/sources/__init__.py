"""Sources and sinks: fixed-schema Parquet tables, the loader and commit
path, a PostgreSQL JDBC reader, the mapping of the driver's TPC-H-like
tables onto the domain."""

from stipendlens.sources.mapping import Domain, StoredDomain, load_domain, load_stored_domain
from stipendlens.sources.snapshots import Change, ConcurrentCommit, Snapshot, commit, read_snapshot, vacuum
from stipendlens.sources.tables import (commit_delete, commit_result, json_columns, read_domain, read_domain_table, read_postgres_table,
                                        read_raw, to_json, write_domain, write_domain_table, write_json)

__all__ = ["Change", "ConcurrentCommit", "Domain", "Snapshot", "StoredDomain", "commit", "commit_delete", "commit_result", "json_columns",
           "load_domain", "load_stored_domain", "read_domain", "read_domain_table", "read_postgres_table", "read_raw", "read_snapshot",
           "to_json", "vacuum", "write_domain", "write_domain_table", "write_json"]
