"""pressloom.sources"""
