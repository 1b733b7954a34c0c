"""PySpark operators for timed, speaker-attributed text: turns, intervals, stories, ranking, reports."""
