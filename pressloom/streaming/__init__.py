"""pressloom.streaming"""
