"""Stage plans: each turns input tables into output tables."""
