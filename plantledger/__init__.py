"""Operations-data jobs (move and prove, trace and account, report and patch) on Spark."""
