"""Rules, taint words, checks and dimensions as data; operators turn them into columns."""
