"""DataFrame operators: schedules, event lifecycle, deduplication, planning, reports."""
