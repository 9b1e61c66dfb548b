"""Trip ledger: keep analytical trip tables right while their input changes, on Spark."""
