"""leafloom.plans"""
