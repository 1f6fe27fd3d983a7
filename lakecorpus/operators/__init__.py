"""lakecorpus.operators"""
