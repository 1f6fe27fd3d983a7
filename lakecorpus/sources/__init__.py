"""lakecorpus.sources"""
