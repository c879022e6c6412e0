"""DataFrame operators: results, inventory, table inspection, job log, ordered rows."""
