"""leafloom.sources"""
