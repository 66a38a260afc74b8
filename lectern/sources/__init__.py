"""lectern.sources"""
