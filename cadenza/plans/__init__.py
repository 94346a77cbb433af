"""The ride report: from raw samples to laps, corners, sectors, surges and summaries of any number of rides."""
