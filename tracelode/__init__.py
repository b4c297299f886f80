"""tracelode: analytics over labelled event sequences and text corpora, on Spark."""
