"""pressloom.functions"""
