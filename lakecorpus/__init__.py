"""lakecorpus: a PySpark-native engine for building and analysing text corpora."""
