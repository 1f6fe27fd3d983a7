"""lakecorpus.streaming"""
