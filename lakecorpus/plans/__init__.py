"""lakecorpus.plans"""
