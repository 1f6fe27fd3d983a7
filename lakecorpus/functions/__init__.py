"""lakecorpus.functions"""
